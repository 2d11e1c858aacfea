"""Neighbours and neighbourhoods of one node."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..storage import Scratch


def _steps(g: PropertyGraph, types: Iterable[str] | None, direction: str) -> DataFrame:
    e = g.all_edges(types)
    out = e.select("etype", F.col("src").alias("f"), F.col("dst").alias("t"), "src", "dst")
    back = e.select("etype", F.col("dst").alias("f"), F.col("src").alias("t"), "src", "dst")
    return out if direction == "out" else back if direction == "in" else out.unionAll(back.where("src != dst"))


def neighbors(g: PropertyGraph, key: str, etype: str | None = None, direction: str = "out") -> DataFrame:
    """key of the nodes one edge away."""
    return _steps(g, [etype] if etype else None, direction).where(F.col("f") == key).select(F.col("t").alias("key")).distinct()


def neighborhood(g: PropertyGraph, key: str, depth: int = 1, types: Iterable[str] | None = None, direction: str = "both") -> DataFrame:
    """key, depth of the nodes that can be reached, at the depth they are first seen; the start is left out."""
    e = _steps(g, types, direction).select("f", "t")
    seen = g.spark.createDataFrame([(key, 0)], "key string, depth int")
    front = seen
    scratch = Scratch()
    for d in range(1, depth + 1):
        if d > 2:  # what was reached is used twice in each further step
            front, seen = scratch(front, "reached"), scratch(seen, "seen")
        front = front.join(e, F.col("key") == F.col("f")).select(F.col("t").alias("key")).distinct().join(seen.select("key"), "key", "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionAll(front)
    return seen.where("depth > 0").select("key", F.col("depth").cast("bigint").alias("depth"))


def grouped_by_edge_type(g: PropertyGraph, key: str, direction: str = "both") -> DataFrame:
    """etype, keys: the neighbours by edge type, sorted."""
    return _steps(g, None, direction).where(F.col("f") == key).groupBy("etype").agg(F.array_sort(F.collect_set("t")).alias("keys"))


def node_edges(g: PropertyGraph, key: str) -> DataFrame:
    """etype, src, dst, derived, rule of all edges at a node."""
    out = None
    for name in sorted(g.edges):
        e = g.edges[name]
        rule = F.col("rule") if "rule" in e.df.columns else F.lit(None).cast("string")
        x = e.df.where((F.col("src") == key) | (F.col("dst") == key)).select(F.lit(name).alias("etype"), "src", "dst", rule.isNotNull().alias("derived"), rule.alias("rule"))
        out = x if out is None else out.unionAll(x)
    return out
