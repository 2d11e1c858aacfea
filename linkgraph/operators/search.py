"""Full-text search ranked by BM25, vector search, and both together.

Tokens are runs of letters and digits in lower case, stemmed unless the caller asks for them as they are. A query is groups joined by
OR; in a group all terms must match: words, "phrases", prefix* and -exclusions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stem import stem as stem_word
from ..model import PropertyGraph
from ..storage import ship
from .rules import cosine

K1, B = 1.2, 0.75
RRF = 60
PAIR_MOST = 8192


@dataclass
class Group:
    words: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    prefixes: list[str] = field(default_factory=list)
    without: list[str] = field(default_factory=list)

    @property
    def positive(self) -> bool:
        return bool(self.words or self.phrases or self.prefixes)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def parse_query(text: str, stem: bool = True) -> list[Group]:
    """Groups of a query; a group of exclusions only is dropped."""
    fix = stem_word if stem else (lambda w: w)
    groups = [Group()]
    for m in re.finditer(r'"([^"]*)"|(\S+)', text):
        if m[1] is not None:
            ws = [fix(w) for w in words_of(m[1])]
            if len(ws) == 1:
                groups[-1].words += ws
            elif ws:
                groups[-1].phrases.append(ws)
            continue
        t = m[2]
        if t == "OR":
            groups.append(Group())
        elif t.startswith("-") and len(t) > 1:
            groups[-1].without += [fix(w) for w in words_of(t)]
        elif t.endswith("*") and words_of(t):
            *head, last = words_of(t)
            groups[-1].words += [fix(w) for w in head]
            groups[-1].prefixes.append(last)
        else:
            groups[-1].words += [fix(w) for w in words_of(t)]
    return [g for g in groups if g.positive]




@F.pandas_udf(T.ArrayType(T.StringType()))
def _stemmed(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda ts: None if ts is None else [stem_word(t) for t in ts])


@F.pandas_udf(T.StringType())
def stemmed_word(tokens: pd.Series) -> pd.Series:
    return tokens.map(stem_word)


def tokens(text: Column, stem: bool = True) -> Column:
    """Tokens of a text in order."""
    out = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return _stemmed(out) if stem else out


def _positions(c: Column, kind: T.DataType, stem: bool) -> Column:
    """Tokens with their places; elements of a list stand two places apart, so that no phrase spans them."""
    if isinstance(kind, T.ArrayType):
        parts = F.transform(F.filter(c, lambda x: x.isNotNull()), lambda x: F.concat(F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array(F.lit(""), F.lit(""))))
        flat = F.flatten(parts)
        return _stemmed(flat) if stem else flat
    return tokens(c, stem)


def _is(word: str):
    return lambda t: t == F.lit(word)


def _begins(prefix: str):
    return lambda t: t.startswith(prefix)


def _holds(ts: Column, g: Group) -> Column:
    out = F.lit(True)
    for w in g.words:
        out = out & F.array_contains(ts, w)
    for p in g.prefixes:
        out = out & F.exists(ts, _begins(p))
    for ph in g.phrases:
        text = F.concat(F.lit(" "), F.array_join(ts, " "), F.lit(" "))
        out = out & text.contains(" " + " ".join(ph) + " ")
    for w in g.without:
        out = out & ~F.array_contains(ts, w)
    return out


def matches(text: Column, query: str, stem: bool = True) -> Column:
    """Whether a text matches a query; no index is needed."""
    groups = parse_query(query, stem)
    ts = tokens(text, stem)
    out = F.lit(False)
    for g in groups:
        out = out | _holds(ts, g)
    return F.when(text.isNotNull(), out)


def corpus(g: PropertyGraph, name: str, stem: bool, label: str | None) -> DataFrame:
    out = None
    for lab, df in sorted(g.nodes.items()):
        if name in df.columns and (label is None or lab == label):
            x = df.where(F.col(f"`{name}`").isNotNull()).select("key", _positions(F.col(f"`{name}`"), df.schema[name].dataType, stem).alias("ts"))
            out = x if out is None else out.unionAll(x)
    return out if out is not None else g.spark.createDataFrame([], "key string, ts array<string>")


def search(g: PropertyGraph, name: str, query: str, k: int | None = 10, stem: bool = True, label: str | None = None) -> DataFrame:
    """key, score: the k best nodes whose field matches the query, by BM25; ties by key.

    The corpus is read once for its statistics and once for the matches; only counts of the query's terms are shuffled.
    """
    ship(g.spark)
    groups = parse_query(query, stem)
    docs = corpus(g, name, stem, label).select("key", F.filter("ts", lambda t: t != "").alias("words"), "ts")
    if not groups:
        return docs.select("key", F.lit(0.0).alias("score")).limit(0)
    words = sorted({w for x in groups for w in x.words} | {w for x in groups for ph in x.phrases for w in ph})
    prefixes = sorted({p for x in groups for p in x.prefixes})
    tf = {**{("w", w): F.size(F.filter("words", _is(w))) for w in words}, **{("p", p): F.size(F.filter("words", _begins(p))) for p in prefixes}}
    names = {t: f"tf{i}" for i, t in enumerate(tf)}
    counted = docs.select("key", "ts", F.size("words").alias("len"), *[c.alias(names[t]) for t, c in tf.items()])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(names[t]) > 0).alias(f"df_{names[t]}") for t in tf])
    rows = counted.crossJoin(F.broadcast(stats))  # one row

    def part(t) -> Column:
        n, df = F.col("n"), F.col(f"df_{names[t]}")
        idf = F.ln((n - df + 0.5) / (df + 0.5) + 1)
        f = F.col(names[t])
        return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))).otherwise(0.0)

    score, hit = F.lit(0.0), F.lit(False)
    for x in groups:
        terms = [("w", w) for w in dict.fromkeys(x.words + [w for ph in x.phrases for w in ph])] + [("p", p) for p in dict.fromkeys(x.prefixes)]
        s = F.lit(0.0)
        for t in terms:
            s = s + part(t)
        ok = _holds(F.col("ts"), x)
        score = score + F.when(ok, s).otherwise(0.0)
        hit = hit | ok
    out = rows.where(hit).select("key", score.alias("score"))
    return out if k is None else out.orderBy(F.col("score").desc(), "key").limit(k)


def find_similar(g: PropertyGraph, name: str, vector: list[float], label: str | None = None, k: int = 10, min: float = 0.8, where: Column | None = None, exclude: str | None = None) -> DataFrame:
    """key, score: the k nodes whose vector has the greatest cosine with this one, of at least min."""
    out = None
    v = F.array(*[F.lit(float(x)) for x in vector])
    for lab, df in sorted(g.nodes.items()):
        if name in df.columns and (label is None or lab == label):
            df = df.where(where) if where is not None else df
            x = df.select("key", cosine(F.col(f"`{name}`"), v).alias("score"))
            out = x if out is None else out.unionAll(x)
    if out is None:
        return g.spark.createDataFrame([], "key string, score double")
    out = out.where(F.col("score") >= min)
    if exclude is not None:
        out = out.where(F.col("key") != exclude)
    return out.orderBy(F.col("score").desc(), "key").limit(k)


def pairwise_similar(g: PropertyGraph, keys: Iterable[str], name: str, k: int = 10, min: float = 0.0) -> DataFrame:
    """src, dst, score: for each of the keys its k most similar among them, itself excluded."""
    keys = list(dict.fromkeys(keys))
    if len(keys) > PAIR_MOST:
        raise ValueError(f"{PAIR_MOST} keys at most")
    out = None
    for _, df in sorted(g.nodes.items()):
        if name in df.columns:
            x = df.where(F.col("key").isin(*keys)).select("key", F.col(f"`{name}`").alias("v"))
            out = x if out is None else out.unionAll(x)
    a, b = out.select(F.col("key").alias("src"), F.col("v").alias("va")), out.select(F.col("key").alias("dst"), F.col("v").alias("vb"))
    found = a.join(b, F.col("src") != F.col("dst")).select("src", "dst", cosine(F.col("va"), F.col("vb")).alias("score")).where(F.col("score") >= min)
    best = W.partitionBy("src").orderBy(F.col("score").desc(), "dst")
    return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def search_hybrid(g: PropertyGraph, text_field: str, query: str, vector_field: str, vector: list[float], k: int = 10, label: str | None = None, stem: bool = True) -> DataFrame:
    """key, score: reciprocal ranks of both searches, 4 k deep each, added up; ties by key."""
    by = W.orderBy(F.col("score").desc(), "key")  # over 4 k rows
    legs = [search(g, text_field, query, 4 * k, stem, label), find_similar(g, vector_field, vector, label, 4 * k, 0.0)]
    a, b = (x.select("key", (1.0 / (RRF + F.row_number().over(by))).alias(f"s{i}")) for i, x in enumerate(legs))
    both = a.join(b, "key", "full_outer").select("key", (F.coalesce("s0", F.lit(0.0)) + F.coalesce("s1", F.lit(0.0))).alias("score"))
    return both.orderBy(F.col("score").desc(), "key").limit(k)


def recall(g: PropertyGraph, topic: str, fields: Iterable[str], k: int = 10, terms_most: int = 24, stem: bool = True) -> DataFrame:
    """key, coverage, score: nodes that hold at least half of the topic's terms in some field, by coverage, score, key."""
    terms = list(dict.fromkeys((stem_word if stem else str)(w) for w in words_of(topic)))[:terms_most]
    if not terms:
        return g.spark.createDataFrame([], "key string, coverage bigint, score double")
    out = None
    for f in fields:
        hits = search(g, f, " OR ".join(words_of(topic)[:terms_most]), None, stem).select("key", "score")
        cov = corpus(g, f, stem, None).select("key", sum((F.array_contains("ts", t).cast("int") for t in terms), F.lit(0)).alias("coverage"))
        x = hits.join(cov, "key")
        out = x if out is None else out.unionAll(x)
    out = out.groupBy("key").agg(F.max("coverage").cast("bigint").alias("coverage"), F.max("score").alias("score"))
    return out.where(F.col("coverage") * 2 >= len(terms)).orderBy(F.col("coverage").desc(), F.col("score").desc(), "key").limit(k)


def identity_clusters(g: PropertyGraph, label: str, name: str, aliases: str | None = None, least: float = 0.6) -> DataFrame:
    """key, cluster: nodes whose names (or an alias) share at least that Jaccard of tokens, clustered so that all of a cluster are alike.

    Links come from a token join; each connected group of them is clustered in one task, oldest key first.
    """
    from ..storage import Scratch
    from .components import components
    from .rules import Overlap, pairs

    ship(g.spark)
    scratch = Scratch()
    df = g.nodes[label]
    forms = df.select(F.col("key").alias("who"), F.explode(F.concat(F.array(name), F.coalesce(aliases, F.array()) if aliases else F.array())).alias("form")).where("form is not null")
    forms = forms.select("who", F.array_sort(F.array_distinct(tokens(F.col("form"), False))).alias("ts")).where(F.size("ts") > 0)
    # nodes with the same sets of tokens are alike to the same others, so that the oldest of them stands for all
    named = forms.groupBy("who").agg(F.array_sort(F.collect_set("ts")).alias("names"))
    oldest = scratch(named.groupBy("names").agg(F.min("who").alias("first")), "identity-names")
    sets = oldest.select(F.explode("names").alias("ts"), "first").groupBy("ts").agg(F.collect_list("first").alias("firsts")).select(F.md5(F.to_json(F.struct("ts"))).alias("key"), "ts", "firsts")
    sets = scratch(sets, "identity-sets")
    p = pairs(Overlap("ts", least), sets, sets)
    links = p.join(sets.select(F.col("key").alias("s"), F.col("firsts").alias("xs")), "s").join(sets.select(F.col("key").alias("d"), F.col("firsts").alias("ys")), "d")
    links = links.select("score", "ys", F.explode("xs").alias("a")).select("score", "a", F.explode("ys").alias("b")).where("a < b").groupBy("a", "b").agg(F.max("score").alias("score"))
    links = scratch(links, "identity")
    comp = components(links.select("a", "b"), scratch)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        alike = {(a, b) for a, b in zip(pdf.a, pdf.b, strict=True)}
        clusters: list[list[str]] = []
        for k in sorted(set(pdf.a) | set(pdf.b)):
            home = next((c for c in clusters if all((min(x, k), max(x, k)) in alike for x in c)), None)
            if home is None:
                clusters.append([k])
            else:
                home.append(k)
        return pd.DataFrame([(k, c[0]) for c in clusters for k in c], columns=["key", "cluster"])

    found = links.join(comp.select(F.col("id").alias("a"), "component"), "a").groupBy("component").applyInPandas(run, "key string, cluster string")
    of = named.join(oldest, "names").select(F.col("who").alias("key"), "first").join(found.select(F.col("key").alias("first"), "cluster"), "first", "left")
    of = of.select("key", F.coalesce("cluster", "first").alias("cluster"))
    return df.select("key").join(of, "key", "left").select("key", F.coalesce("cluster", "key").alias("cluster"))
