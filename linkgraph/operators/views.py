"""Materialised views per node: degrees and aggregates over neighbours, and their upkeep."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import PropertyGraph


@dataclass(frozen=True)
class Degree:
    name: str
    label: str
    etype: str
    direction: str = "out"


@dataclass(frozen=True)
class NeighborAgg:
    """Sum and Count are 0 without neighbours that have the property, Avg, Min and Max are null."""

    name: str
    label: str
    etype: str
    prop: str
    func: str  # sum, avg, min, max, count
    direction: str = "out"


def view(g: PropertyGraph, v: Degree | NeighborAgg, keys: DataFrame | None = None) -> DataFrame:
    """key and the view's value for the nodes of its label; keys: only for these."""
    nodes = g.nodes[v.label].select("key")
    if keys is not None:
        nodes = nodes.join(keys.select("key").distinct(), "key", "left_semi")
    e = g.edges.get(v.etype)
    e = e.df.select("src", "dst") if e else g.spark.createDataFrame([], "src string, dst string")
    ways = [("src", "dst")] if v.direction == "out" else [("dst", "src")] if v.direction == "in" else [("src", "dst"), ("dst", "src")]
    steps = None
    for a, b in ways:
        x = e.select(F.col(a).alias("key"), F.col(b).alias("to"))
        steps = x if steps is None else steps.unionAll(x)
    if keys is not None:
        steps = steps.join(nodes, "key", "left_semi")
    if isinstance(v, Degree):
        n = steps.groupBy("key").agg(F.count("*").alias("value"))
        return nodes.join(n, "key", "left").select("key", F.coalesce("value", F.lit(0)).cast("bigint").alias(v.name))
    values = None
    for df in g.nodes.values():
        if v.prop in df.columns:
            x = df.select(F.col("key").alias("to"), F.col(f"`{v.prop}`").cast("double").alias("x"))
            values = x if values is None else values.unionAll(x)
    if values is None:
        values = g.spark.createDataFrame([], "to string, x double")
    got = steps.join(values.where("x is not null"), "to").groupBy("key").agg({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count}[v.func.lower()]("x").alias("value"))
    value = F.col("value")
    if v.func.lower() == "sum":
        value = F.coalesce(value, F.lit(0.0))
    elif v.func.lower() == "count":
        value = F.coalesce(value, F.lit(0)).cast("bigint")
    return nodes.join(got, "key", "left").select("key", value.alias(v.name))


def refresh(g: PropertyGraph, v: Degree | NeighborAgg, old: DataFrame, touched: DataFrame) -> DataFrame:
    """The view after changes: only touched keys are computed again. touched must hold the ends of changed edges and the neighbours of changed nodes."""
    return old.join(touched.select("key").distinct(), "key", "left_anti").unionByName(view(g, v, touched))


def touched_by(g: PropertyGraph, v: Degree | NeighborAgg, changed: DataFrame) -> DataFrame:
    """Keys whose view may change when these nodes (key) change: themselves and the nodes that see them."""
    e = g.edges[v.etype].df
    back = e.join(changed.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key"))
    fore = e.join(changed.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key"))
    return changed.select("key").unionAll(back).unionAll(fore).distinct()
