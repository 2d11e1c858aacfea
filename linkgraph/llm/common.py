"""Helpers shared by the text operators: table access, materialising, prefix sums, bitmaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, materialize, ship

__all__ = ["Scratch", "materialize", "ship"]

#: Bits of a membership bitmap at most: 16 MB, whatever the input.
BITMAP_BITS = 1 << 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, *cols: str, keep: str | None = None) -> DataFrame:
    """Only the named columns; with keep, all of the row as one struct of that name, so that no column can clash."""
    ship(df.sparkSession)
    out = [F.col(f"`{c}`").alias(c) for c in cols]
    if keep:
        out.append(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(keep))
    return df.select(*out)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, mod n; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def prefix_sums(df: DataFrame, group: str, bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds out, the sum of value over the rows of the group up to and with each row, by (bucket, order).

    bucket is an integer that grows with the order. Rows are dealt by (group, bucket), so a group
    that holds most rows is spread over all its buckets; only one row a bucket is summed by group.
    """
    from pyspark.sql import Window as W

    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    w = W.partitionBy(group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(w), F.lit(0)).cast("long").alias("_before"))
    inner = W.partitionBy(group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = df.join(offsets, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col(bucket) == F.col("_b")), "left")
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(inner)).drop("_g", "_b", "_before")


def bitmap(ids: DataFrame, column: str, count: int) -> np.ndarray:
    """A set of 64-bit integers as bits: 16 bits an id, BITMAP_BITS at most. False members are possible, lost ones not.

    The words of the bitmap are put together by the executors; the driver gets at most BITMAP_BITS / 8 bytes.
    """
    bits = 1 << 16
    while bits < 16 * count and bits < BITMAP_BITS:
        bits *= 2
    slot = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits))
    chunk = 1 << 15
    where = ids.select(slot.alias("s")).select(F.floor(F.col("s") / chunk).cast("int").alias("c"), (F.col("s") % chunk).cast("int").alias("s"))
    rows = where.groupBy("c").agg(F.bitmap_construct_agg("s").alias("m")).collect()  # at most BITMAP_BITS / chunk rows of 4 KB
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        m = np.frombuffer(r["m"], np.uint8)
        out[r["c"] * (chunk // 8) : r["c"] * (chunk // 8) + chunk // 8] = m[: chunk // 8]
    return out


def slot_of(column: Column, bits: int) -> Column:
    """The bit of an id in a bitmap of so many bits, the same as bitmap() sets."""
    return F.pmod(F.xxhash64(column.cast("long")), F.lit(bits))


def has_bit(mask: np.ndarray, slots: np.ndarray) -> np.ndarray:
    slots = slots.astype(np.int64)
    return (mask[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 > 0


def maybe_in(mask: np.ndarray, spark: SparkSession):
    """A function from an id column to a boolean one: false only for ids that are not in the bitmap."""
    shared, bits = spark.sparkContext.broadcast(mask), len(mask) * 8  # BITMAP_BITS / 8 bytes at most

    @F.arrow_udf("boolean")  # pandas would take 24 MB of each worker
    def member(slots: pa.Array) -> pa.Array:
        return pa.array(has_bit(shared.value, slots.to_numpy(zero_copy_only=False)))

    return lambda column: member(slot_of(column, bits))


def split_by_ids(docs: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows that are surely not among the ids, rows that may be): so that only few texts need to be shuffled. ids: distinct, in column k."""
    spark = docs.sparkSession
    test = maybe_in(bitmap(ids, "k", ids.count()), spark)(F.coalesce(docs[id_column].cast("long"), F.lit(0)))
    return docs.where(~test), docs.where(test)


def without_ids(docs: DataFrame, ids: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is not in column k of ids."""
    sure, may = split_by_ids(docs, ids, id_column)
    return sure.unionByName(may.join(ids, may[id_column] == ids["k"], "left_anti"))


#: Keys that hold more than one row in so many are hot: there are at most as many of them, so a broadcast of them is bounded.
HOT_KEYS = 4096


def join_counted(left: DataFrame, right: DataFrame, on: list[str], count: str) -> DataFrame:
    """left join right by columns of the same names; right has one row a key, with the number of left's rows of that key in count.

    A key that holds a large share of the rows would put them all into one task. Right's rows of such
    keys, HOT_KEYS at most, are broadcast instead; all other keys meet by a shuffle. left and right are
    read twice, so both should be written tables. Rows without a partner are dropped.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_KEYS > F.lit(total)
    often = right.where(hot).drop(count)
    if not often.limit(1).count():
        return left.join(right.drop(count), on)
    keys = F.broadcast(often.select(*on))
    rest = left.join(keys, on, "left_anti").join(right.where(~hot).drop(count), on)
    return left.join(F.broadcast(often), on).unionByName(rest)
