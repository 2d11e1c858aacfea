"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Scratch


def _large(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(low.select("u", F.col("m").alias("v"))).distinct()


def _mark(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """id, component (the smallest id that can be reached) of every id in links (a, b); ids without links are not listed.

    Each round is a few joins and a written table, and needs no row of another round; the number of
    rounds grows with the logarithm of the longest chain, not with its length.
    """
    name = f"cc{uuid.uuid4().hex[:8]}"
    e = scratch(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = _mark(e)
    for _ in range(rounds):
        if not mark[0]:
            break
        e = scratch(_small(_large(e)), name)
        new = _mark(e)
        scratch.release(name)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
