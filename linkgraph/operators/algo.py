"""Graph algorithms over all edges or some types: PageRank, components, degrees, communities."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..storage import Scratch, ship
from .components import components


#: Nodes and edges together up to which one task runs an algorithm on arrays: some 100 bytes each. Beyond it the iterations are distributed.
SMALL = 4_000_000


def _arrays(nodes: DataFrame, edges: DataFrame, kernel, value: str) -> DataFrame:
    """key and a value of each node (key): kernel(n, src, dst, w) in one task, nodes numbered in the order of their keys. edges: src, dst, w between nodes."""

    def run(batches):
        t = pa.Table.from_batches(list(batches))
        bare = t.column("dst").is_null().to_numpy()
        src = t.column("src").to_numpy(zero_copy_only=False)
        keys = np.sort(src[bare].astype(str).astype(object))
        at = pd.Index(keys)
        s, d = at.get_indexer(src[~bare]), at.get_indexer(t.column("dst").to_numpy(zero_copy_only=False)[~bare])
        out = kernel(keys, s, d, t.column("w").to_numpy()[~bare])
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out)], ["key", value.split()[0]])

    none = F.lit(None).cast("string")
    rows = nodes.select(F.col("key").alias("src"), none.alias("dst"), F.lit(0.0).alias("w")).unionAll(edges.select("src", "dst", "w"))
    return rows.coalesce(1).mapInArrow(run, f"key string, {value}")


def weighted_edges(g: PropertyGraph, types: Iterable[str] | None, weight_prop: str | None, min_weight: float | None) -> DataFrame:
    """src, dst, w between nodes of the graph; without weights parallel edges count once."""
    out = None
    for name in sorted(g.edges if types is None else [t for t in types if t in g.edges]):
        df = g.edges[name].df
        w = F.col(f"`{weight_prop}`").cast("double") if weight_prop and weight_prop in df.columns else F.lit(1.0 if not weight_prop else None).cast("double")
        e = df.select("src", "dst", w.alias("w"))
        out = e if out is None else out.unionAll(e)
    if out is None:
        return g.spark.createDataFrame([], "src string, dst string, w double")
    if weight_prop or min_weight is not None:
        out = out.where(F.col("w") >= (min_weight if min_weight is not None else float("-inf"))).where("w is not null")
    return out if weight_prop else out.select("src", "dst", F.lit(1.0).alias("w")).distinct()


def pagerank(g: PropertyGraph, types: Iterable[str] | None = None, damping: float = 0.85, max_iter: int = 50, tol: float = 1e-6, direction: str = "out", weight_prop: str | None = None, min_weight: float | None = None, labels: Iterable[str] | None = None) -> DataFrame:
    """key, score. Mass of nodes without out-edges is spread evenly; stops when the scores move less than tol in sum.

    Each iteration is one join and one aggregation over the edges, written to the shared folder; the driver reads two numbers.
    """
    ship(g.spark)
    scratch = Scratch()
    e = weighted_edges(g, types, weight_prop, min_weight)
    if direction == "in":
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    elif direction == "both":
        e = e.unionAll(e.select("dst", "src", "w"))
        e = e if weight_prop else e.distinct()
    nodes = scratch(g.all_nodes(labels).select("key").distinct(), "pr-nodes")
    n = nodes.count()
    if not n:
        return nodes.select("key", F.lit(0.0).alias("score"))
    ends = nodes.select(F.col("key").alias("src"))
    e = e.join(ends, "src", "left_semi").join(nodes.select(F.col("key").alias("dst")), "dst", "left_semi")
    if n <= SMALL and (e := scratch(e, "pr-links")).count() + n <= SMALL:
        return _arrays(nodes, e, _rank_kernel(damping, max_iter, tol), "score double")
    total = e.groupBy("src").agg(F.sum("w").alias("total"))
    e = scratch(e.join(total, "src").where("total > 0").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "pr-edges")
    sends = e.select(F.col("src").alias("key")).distinct().withColumn("sends", F.lit(True))
    rank = scratch(nodes.join(sends, "key", "left").select("key", F.coalesce("sends", F.lit(False)).alias("sends"), F.lit(1.0 / n).alias("score")), "pr")
    lost = F.coalesce(F.sum(F.when(~F.col("sends"), F.col("score"))), F.lit(0.0))
    dangling = rank.agg(lost).first()[0]
    for _ in range(max_iter):
        got = e.join(rank.select(F.col("key").alias("src"), "score"), "src").groupBy(F.col("dst").alias("key")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        new = rank.join(got, "key", "left").select("key", "sends", F.col("score").alias("old"), ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + dangling / n)).alias("score"))
        new = scratch(new, "pr")
        moved, dangling = new.agg(F.sum(F.abs(F.col("score") - F.col("old"))), lost).first()
        rank = new.select("key", "sends", "score")
        scratch.release("pr")
        if moved < tol:
            break
    return rank.select("key", "score")


def _rank_kernel(damping: float, max_iter: int, tol: float):
    def run(keys, s, d, w):
        n = len(keys)
        total = np.bincount(s, weights=w, minlength=n)
        share = np.divide(w, total[s], out=np.zeros(len(w)), where=total[s] > 0)
        lost = total <= 0
        score = np.full(n, 1.0 / n)
        for _ in range(max_iter):
            new = (1 - damping) / n + damping * (np.bincount(d, weights=score[s] * share, minlength=n) + score[lost].sum() / n)
            moved, score = np.abs(new - score).sum(), new
            if moved < tol:
                break
        return score

    return run


def _component_kernel(keys, s, d, w):
    """The smallest key of each node's component: labels fall along edges and by pointer jumping until nothing changes."""
    label = np.arange(len(keys))
    while True:
        low = np.minimum(label[s], label[d])
        new = label.copy()
        np.minimum.at(new, label[s], low)
        np.minimum.at(new, label[d], low)
        new = new[new]
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return keys[label].tolist()
        label = new


def connected_components(g: PropertyGraph, types: Iterable[str] | None = None, labels: Iterable[str] | None = None) -> DataFrame:
    """key, component: the smallest key that can be reached over edges in any direction."""
    ship(g.spark)
    scratch = Scratch()
    nodes = g.all_nodes(labels).select("key").distinct()
    e = g.all_edges(types).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if labels is not None:
        e = e.join(nodes.select(F.col("key").alias("a")), "a", "left_semi").join(nodes.select(F.col("key").alias("b")), "b", "left_semi")
    size = nodes.count()
    if not size:
        return nodes.select("key", F.col("key").alias("component"))
    if size <= SMALL and (e := scratch(e.distinct(), "cc-links")).count() + size <= SMALL:
        known = nodes.select(F.col("key").alias("a"))
        e = e.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi")
        return _arrays(nodes, e.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("w")), _component_kernel, "component string")
    found = components(e, scratch).withColumnRenamed("id", "key")
    return nodes.join(found, "key", "left").select("key", F.coalesce("component", "key").alias("component"))


def degree_centrality(g: PropertyGraph, types: Iterable[str] | None = None, direction: str = "both", labels: Iterable[str] | None = None, weight_prop: str | None = None, min_weight: float | None = None) -> DataFrame:
    """key, degree of every node, 0 included; both counts out and in."""
    e = weighted_edges(g, types, weight_prop, min_weight)
    sides = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    ends = None
    for s in sides:
        x = e.select(F.col(s).alias("key"))
        ends = x if ends is None else ends.unionAll(x)
    n = ends.groupBy("key").agg(F.count("*").alias("degree"))
    return g.all_nodes(labels).select("key").join(n, "key", "left").select("key", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))


def degree(g: PropertyGraph, key: str, types: Iterable[str] | None = None, direction: str = "both") -> int:
    """Neighbours of one node, each once a direction; raises KeyError for a key that no node has."""
    if not g.all_nodes().where(F.col("key") == key).limit(1).count():
        raise KeyError(key)
    e = g.all_edges(types)
    out = e.where(F.col("src") == key).select("dst").distinct().count() if direction in ("out", "both") else 0
    return out + (e.where(F.col("dst") == key).select("src").distinct().count() if direction in ("in", "both") else 0)


def degrees(g: PropertyGraph, keys: Iterable[str] | None = None, label: str | None = None, types: Iterable[str] | None = None, direction: str = "both", limit: int | None = None) -> DataFrame:
    """key, degree by degree descending, then key; keys that no node has are left out."""
    e = g.all_edges(types).select("src", "dst").distinct()
    one = [e.select(F.col("src").alias("key"))] if direction == "out" else [e.select(F.col("dst").alias("key"))] if direction == "in" else [e.select(F.col("src").alias("key")), e.select(F.col("dst").alias("key"))]
    ends = one[0] if len(one) == 1 else one[0].unionAll(one[1])
    nodes = g.all_nodes([label] if label else None).select("key")
    if keys is not None:
        nodes = nodes.where(F.col("key").isin(*keys))
    out = nodes.join(ends.groupBy("key").agg(F.count("*").alias("degree")), "key", "left").select("key", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree")).orderBy(F.col("degree").desc(), "key")
    return out.limit(limit) if limit is not None else out


def louvain_of(edges: list[tuple[str, str, float]], resolution: float = 1.0, passes: int = 10, sweeps: int = 20, least: float = 1e-12) -> dict[str, int]:
    """Communities by local moves in sorted key order, then the same among the communities, until nothing improves."""
    keys = sorted({k for a, b, _ in edges for k in (a, b)})
    place = {k: i for i, k in enumerate(keys)}
    adjacent: list[dict[int, float]] = [{} for _ in keys]
    inside = [0.0] * len(keys)
    for a, b, w in edges:
        i, j = place[a], place[b]
        if i != j:
            adjacent[i][j] = adjacent[i].get(j, 0.0) + w
            adjacent[j][i] = adjacent[j].get(i, 0.0) + w
    member = list(range(len(keys)))
    m2 = sum(sum(x.values()) for x in adjacent)
    for _ in range(passes if m2 > 0 else 0):
        n = len(adjacent)
        com = list(range(n))
        k = [sum(adjacent[i].values()) + inside[i] for i in range(n)]
        total = k[:]
        moved_any = False
        for _ in range(sweeps):
            moved = False
            for i in range(n):
                own = com[i]
                links: dict[int, float] = {}
                for j, w in adjacent[i].items():
                    links[com[j]] = links.get(com[j], 0.0) + w
                total[own] -= k[i]
                stay = links.get(own, 0.0) - resolution * total[own] * k[i] / m2
                best, gain = own, least
                for c in sorted(links):
                    if c != own:
                        d = links[c] - resolution * total[c] * k[i] / m2 - stay
                        if d > gain:
                            best, gain = c, d
                total[best] += k[i]
                if best != own:
                    com[i] = best
                    moved = moved_any = True
            if not moved:
                break
        if not moved_any:
            break
        names = {c: x for x, c in enumerate(dict.fromkeys(com))}
        com = [names[c] for c in com]
        member = [com[x] for x in member]
        nxt: list[dict[int, float]] = [{} for _ in names]
        inner = [0.0] * len(names)
        for i in range(n):
            inner[com[i]] += inside[i]
            for j, w in adjacent[i].items():
                if com[i] == com[j]:
                    inner[com[i]] += w
                else:
                    nxt[com[i]][com[j]] = nxt[com[i]].get(com[j], 0.0) + w
        adjacent, inside = nxt, inner
    return {key: member[i] for key, i in place.items()}


def communities(g: PropertyGraph, types: Iterable[str] | None = None, resolution: float = 1.0, weight_prop: str | None = None) -> DataFrame:
    """community (its smallest key), size, key, internal_weight, cohesion of every node that has edges, by Louvain.

    Louvain moves one node after another, so each connected component is one task; components are worked off in
    parallel, and modularity, which compares with the whole graph's weight, gets that weight as a number.
    """
    ship(g.spark)
    scratch = Scratch()
    e = weighted_edges(g, types, weight_prop, None).where("src != dst")
    e = e.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w"))
    e = scratch(e, "louvain-edges")
    everything = e.agg(F.sum("w")).first()[0] or 0.0
    comp = components(e.select("a", "b"), scratch)
    parts = e.join(comp.select(F.col("id").alias("a"), "component"), "a")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        edges = list(zip(pdf.a, pdf.b, pdf.w.astype(float), strict=True))
        own = sum(w for *_, w in edges)
        found = louvain_of(edges, resolution * own / everything if everything else resolution)
        low: dict[int, str] = {}
        for k in sorted(found):
            low.setdefault(found[k], k)
        inner: dict[int, float] = {}
        cut: dict[int, float] = {}
        for a, b, w in edges:
            if found[a] == found[b]:
                inner[found[a]] = inner.get(found[a], 0.0) + w
            else:
                for k in (a, b):
                    cut[found[k]] = cut.get(found[k], 0.0) + w
        size = pd.Series(list(found.values())).value_counts()
        return pd.DataFrame([(low[c], int(size[c]), k, inner.get(c, 0.0), inner.get(c, 0.0) / max(inner.get(c, 0.0) + cut.get(c, 0.0), 1e-300)) for k, c in found.items()], columns=["community", "size", "key", "internal_weight", "cohesion"])

    return parts.groupBy("component").applyInPandas(run, "community string, size bigint, key string, internal_weight double, cohesion double")


def modularity(g: PropertyGraph, found: DataFrame, types: Iterable[str] | None = None, resolution: float = 1.0) -> float:
    e = weighted_edges(g, types, None, None).where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    c = found.select("key", "community")
    e = e.join(c.select(F.col("key").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("key").alias("b"), F.col("community").alias("cb")), "b")
    m = e.count()
    inner = e.where("ca = cb").count()
    k = e.select("ca").unionAll(e.select("cb")).groupBy("ca").count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
    return inner / m - resolution * k / (4.0 * m * m) if m else 0.0


def write_scores(g: PropertyGraph, scores: DataFrame, prop: str, value: str = "score") -> PropertyGraph:
    """The graph with a column of scores (key, value) as a property of its nodes."""
    for label, df in g.nodes.items():
        s = scores.select("key", F.col(value).alias(prop))
        g = g.with_nodes(label, df.drop(prop).join(s, "key", "left"))
    return g
