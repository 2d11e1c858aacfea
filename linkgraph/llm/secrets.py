"""Secret scans with DataFrame functions only.

Base rules find assignments, access keys and long hexadecimal runs. The method adds tokens that a
character Markov model of random strings explains better than one of ordinary identifiers: both
models are bigram tables trained from labelled samples, and what is kept of them is one table of
log-likelihood ratios, a literal of the plan.

The place of the n-th match comes from the lengths of the matches and of the texts between them, as
code points. Null and empty texts have no spans. Every row is judged alone: repeated rows and rows
without doc_id get what their text gives, and no shuffle is needed. Matches of one kind never overlap, the
leftmost goes first; spans of different kinds may, and go by start, then kind. Texts of any length are
read in whole. Columns other than doc_id and text don't matter, whatever their names. An empty table
gives no rows.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With the least length inside, these match what the rules leave of [A-Z0-9]+ and [0-9a-f]+: a run that is too short holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Mean log-likelihood ratio a character from which a token counts as random.
LEAST = 0.35

_WORDS = """account action active address admin agent alert alias amount and android animation answer api app append archive array asset async audio auth auto avatar
background balance banner base batch before billing binary block body border bottom boolean branch browser buffer build button byte cache calendar callback camera cancel
capacity card category center change channel character chart check child class clean client clock close cloud code collection color column command comment commit common
compare complete component compute config connect console constant container content context control convert cookie copy core count country create credit current custom
daily dashboard data database date debug default delete delivery deploy description design detail device dialog digest direction directory disable discount display document
domain download draft driver duration dynamic edit editor element email enable encode encoding engine entity entry environment error event example exception execute export
external factory failure feature field file filter final find first flag folder font footer form format forward frame function gallery gateway general generate get global
group handler hash header health height hidden history home host icon identifier image import index info initial input insert install instance integer interface internal
invoice item iterator job join journal json key keyword label language last latest layout leader length level library license limit line link list listener load local
location lock login logout long loop machine main manager manifest map margin market master match media member memory menu message metadata method metric migration minimum
mobile mode model module monitor month mount move name native network next node normal notification number object offset open operation option order organization origin
output owner package page panel parameter parent parse partner password path pattern payment pending percent permission person phone photo picture pipeline pixel plan
platform player plugin point policy pool popup position post prefix preview previous price primary print priority private process product profile program progress project
property protocol provider proxy public publish purchase query queue quick random range rating reader receive record redirect reference refresh region register release
remote remove render repeat replace reply report repository request reset resource response restore result return review role root route router rule runtime sample save
scale schedule schema scope score screen script search second section security select sender sequence serial server service session setting setup share shipping short show
signal simple site size slot snapshot social socket sort source space stack stage standard start state static status step stock storage store stream string structure style
subject submit subscription success suffix summary support switch symbol sync system table target task team template temp test text theme thread threshold ticket time
timeout title toggle token tool top topic total trace track traffic transaction transfer transform translation tree trigger type unit update upload url user username utility
valid value variable vendor version video view visible volume wallet warning watch web weight widget width window worker wrapper write year zone
the that with this from have which their there would about other these because between through und der die nicht eine sich auf mit werden los las para como pero una del
que des les pour dans avec sur est ment tion ation elle aux eau keit heit lich schaft ción mente ando iendo""".split()


def labelled_samples(n: int = 4000, seed: int = 11) -> list[tuple[str, int]]:
    """(text, 1 for a random string, 0 for an ordinary identifier), the training sample of the default model."""
    r = random.Random(seed)
    low, up, dig = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    pools = [dig + "abcdef", low + up + dig, low + up + dig + "+/", low + dig, up + dig, low + up + dig + "_-", dig + "ABCDEF"]
    out = []
    for _ in range(n):
        pool = r.choice(pools)
        out.append(("".join(r.choice(pool) for _ in range(r.randint(20, 48))), 1))
        words = [w for w in (r.choice(_WORDS) for _ in range(r.randint(2, 6))) if w.isascii()]
        style = r.randrange(6)
        if style == 0:
            s = "_".join(words)
        elif style == 1:
            s = words[0] + "".join(w.capitalize() for w in words[1:]) if words else ""
        elif style == 2:
            s = "-".join(words)
        elif style == 3:
            s = "_".join(words).upper()
        elif style == 4:
            s = "/".join(words)
        else:
            s = "".join(words)
        if r.random() < 0.3:
            s += r.choice(["", "_", "-"]) + str(r.randint(0, 2030))
        out.append((s, 0))
    return out


def ratios(samples: list[tuple[str, int]], smooth: float = 0.3) -> list[float]:
    """Log-likelihood ratio of each bigram, at index (place of the first) * letters + (place of the second)."""
    k = len(ALPHABET)
    place = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[smooth] * k for _ in range(k)] for _ in range(2)]
    for s, label in samples:
        for a, b in zip(s, s[1:], strict=False):
            counts[label][place[a]][place[b]] += 1
    out = []
    for i in range(k):
        sums = [sum(counts[label][i]) for label in range(2)]
        out += [round(math.log(counts[1][i][j] / sums[1]) - math.log(counts[0][i][j] / sums[0]), 5) for j in range(k)]
    return out


def _before(lengths: Column, block: int = 64) -> Column:
    """Sums of what stands before each element; in blocks, so that its cost stays near the number of elements."""
    zero = F.array().cast("array<int>")
    grow = lambda xs, start: F.aggregate(xs, F.struct(start.alias("sum"), zero.alias("out")), lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["out"], acc["sum"]).alias("out")))["out"]
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(1), F.size(lengths), F.lit(block))).otherwise(zero)
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(lengths, s, block), F.lit(0), lambda a, x: a + x))
    heads = grow(sums, F.lit(0))
    return F.flatten(F.zip_with(starts, heads, lambda s, h: grow(F.slice(lengths, s, block), h)))


def _marked(kind: int, found: Column, gaps: Column, ok) -> Column:
    """start, kind, end of the matches for which ok(match, index) holds."""
    size = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    spans = F.zip_with(F.zip_with(_before(size), size, lambda b, n: F.struct((b + n).alias("end"))), found, lambda e, m: F.struct((e["end"] - F.length(m)).alias("start"), F.lit(kind).alias("kind"), e["end"].alias("end"), m.alias("text")))
    kept = F.filter(spans, ok) if ok else spans
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, samples: list[tuple[str, int]] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, by start, then kind) and n_random."""
    literal = lambda xs, kind: F.split(F.lit(",".join(map(str, xs))), ",").cast(f"array<{kind}>")  # noqa: E731  folded to one literal of the plan
    table = literal(ratios(samples or labelled_samples()), "double")
    k = len(ALPHABET)
    place = literal([max(ALPHABET.find(chr(c)), 0) for c in range(128)], "int")
    at = lambda t, i: F.get(place, F.ascii(F.substring(t, i, F.lit(1))))
    none = F.array().cast("array<string>")

    def is_random(x: Column) -> Column:
        t = x["text"]
        total = F.aggregate(F.sequence(F.lit(2), F.length(t)), F.lit(0.0), lambda acc, i: acc + F.get(table, at(t, i - 1) * k + at(t, i)))
        return total >= least * (F.length(t) - 1)

    d = packed(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("low", F.lower("t"))
    hint = F.lit(False)
    for word in ("passw", "secret", "token", "api"):
        hint = hint | F.contains("low", F.lit(word))
    every = lambda re, when=None: F.when(F.col("t").rlike(re) if when is None else when, F.regexp_extract_all("t", F.lit(re), F.lit(0))).otherwise(none)
    d = d.select("doc_id", "t", every(ASSIGN, hint).alias("m0"), every(ACCESS, F.contains("t", F.lit("AKIA"))).alias("m1"), every(HEX).alias("m2"), every(TOKEN).alias("m3"))
    gaps = lambda i, re: F.when(F.size(f"m{i}") > 0, F.split("t", re, -1)).otherwise(none).alias(f"g{i}")
    d = d.select("doc_id", "m0", "m1", "m2", "m3", gaps(0, ASSIGN), gaps(1, ACCESS), gaps(2, HEX), gaps(3, TOKEN))
    spans = [_marked(0, F.col("m0"), F.col("g0"), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 2)) >= 12), _marked(1, F.col("m1"), F.col("g1"), None), _marked(2, F.col("m2"), F.col("g2"), None), _marked(3, F.col("m3"), F.col("g3"), is_random)]
    d = d.select("doc_id", *[s.alias(f"s{i}") for i, s in enumerate(spans)])
    names = F.array(*[F.lit(x) for x in KINDS])
    joined = lambda *parts: F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda i, name: F.size(f"s{i}").cast("long").alias(name)
    return d.select("doc_id", n(0, "n_assign"), n(1, "n_access"), n(2, "n_hex"), F.sha2(joined("s0", "s1", "s2"), 256).alias("base_sha256"), joined("s0", "s1", "s2", "s3").alias("spans"), n(3, "n_random"))
