"""Mixing sources to target weights by weighted fair queueing.

Every document gets a virtual finish time: the words its source has sent up to and with it, in a
shuffled order, divided by the source's target. A source whose target exceeds its words sends its
documents again, up to `repeats` times. All copies are dealt out by ranges of finish time; the range
in which their words reach the budget is dealt out again by finer ones, until it holds few rows, which
are sorted; the mix ends there. Copies of other ranges are taken or left whole, so nothing else needs
to be sorted.

Defined results: null, empty and blank texts have no words and are never taken. A null source is a
source of its own, the last one. Rows alike in id, source and size finish together, each taken as
often; rows of one doc_id with other sources or sizes are documents of their own, and so are rows
without doc_id. Equal finish times go by the shuffle, then by source, doc_id, size and turn. Texts of
any length are read in whole. Columns other than doc_id, text and source don't matter, whatever their
names; mixed_rows passes them on. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, packed, prefix_sums

#: Ranges of finish time that one step deals copies to, and rows of the last one that are sorted, by one task.
RANGES, SORTED = 4096, 50_000
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """One row a source: its words, and its share of all words by weight, none above repeats times its words.

    The cap holds for the sources whose cap / weight lies below a level; one pass over the sources in
    that order finds the level. The windows without a key see one row a source, not a document.
    """
    per = sizes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = W.orderBy(F.col("src").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    per = per.select("src", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn.cast("int")).alias("weight"))
    per = per.withColumn("ratio", repeats * F.col("source_size") / F.col("weight"))
    order = W.orderBy("ratio", F.col("src").asc_nulls_last())
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("capped", F.coalesce(F.sum(F.lit(float(repeats)) * F.col("source_size")).over(before), F.lit(0.0)))
    per = per.withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything) - F.col("capped")) / F.col("open_weight"))
    # the first source in this order whose ratio is at or above its level sets the level for itself and all after it
    per = per.withColumn("cut", F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.coalesce(F.col("cut"), F.lit(float("inf"))) * F.col("weight"), repeats * F.col("source_size").cast("double"))
    return per.select("src", "source_size", target.alias("target"))


def shuffle_key(seed: int):
    """62 bits by which the documents of a source are shuffled."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "src", "size"), 2)


def first_beyond(turns: DataFrame, budget: int) -> DataFrame | None:
    """One row, the key of the first copy, in the order of finish times, with which the words exceed the budget; None if they never do.

    Each step sums the words by RANGES ranges of the range in which the budget ends: first of finish
    times, then, among equal ones, of the shuffle. Only the sums come to the driver.
    """
    spent, inside = 0, turns
    while True:
        n, low, high, first, last = inside.agg(F.count("*"), F.min("finish"), F.max("finish"), F.min("mixed"), F.max("mixed")).first()
        by, a, b = ("finish", low, high) if n and low < high else ("mixed", first, last)
        if n <= SORTED or a == b:
            break
        at = F.least(F.lit(RANGES - 1), F.floor((F.col(by) - F.lit(a)) * (RANGES / (b - a)))).cast("int")
        sums = inside.groupBy(at.alias("at")).agg(F.sum("words").alias("words")).orderBy("at").collect()  # RANGES rows at most
        for r in sums:
            if spent + r["words"] > budget:
                inside = inside.where(at == r["at"])
                break
            spent += r["words"]
        else:
            return None
    order = W.orderBy("key").rowsBetween(W.unboundedPreceding, 0)  # over SORTED rows at most
    upto = inside.select(F.struct("finish", "mixed", "src", "doc_id", "size", "turn").alias("key"), "words").withColumn("upto", F.sum("words").over(order) + spent)
    found = upto.where(F.col("upto") > budget).agg(F.min("key").alias("key"))
    return found if found.first()["key"] is not None else None


def takings(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, seed: int = 17, rows_a_bucket: int = 1_000) -> DataFrame:
    """doc_id, src, size, n (rows that are alike in these), source_size, target, turns (how often the mix takes each of them)."""
    scratch = Scratch()
    spark = docs.sparkSession
    sized = docs.select("doc_id", F.col("source").cast("string").alias("src"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = scratch(sized.groupBy("doc_id", "src", "size").agg(F.count("*").alias("n")), "mix-sizes")
    rows, budget, longest = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)), F.coalesce(F.max(F.col("size") * F.col("n")), F.lit(0))).first()
    if not rows:
        return spark.createDataFrame([], sizes.select("*", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).alias("turns")).schema)
    buckets = max(1, min(rows // rows_a_bucket, 1 << 16))
    targets = source_targets(sizes, weights, repeats).select(F.col("src").alias("_src"), "source_size", "target")
    mixed = shuffle_key(seed)
    shuffled = sizes.withColumns({"mixed": mixed, "words": F.col("size") * F.col("n"), "slot": F.floor(mixed * (buckets / (1 << 62))).cast("long")})
    sent = prefix_sums(shuffled, "src", "slot", ["mixed", F.col("doc_id").asc_nulls_first(), "size"], "words", "sent")
    sent = sent.join(F.broadcast(targets) if targets.count() <= 100_000 else targets, F.col("src").eqNullSafe(F.col("_src"))).drop("_src", "slot", "words")
    sent = scratch(sent, "mix-sent")
    turns = sent.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    place = F.col("turn") * F.col("source_size") + F.col("sent")
    # what comes later than a source's target and the longest document can't be reached before the budget is spent
    turns = turns.where(place <= F.col("target") + 2 * longest + 1).select((place / F.col("target")).alias("finish"), "src", "mixed", "doc_id", "size", "turn", (F.col("size") * F.col("n")).alias("words"))
    last = first_beyond(turns, budget)
    finishes = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda t: F.struct(((t * F.col("source_size") + F.col("sent")) / F.col("target")).alias("finish"), F.col("mixed"), F.col("src"), F.col("doc_id"), F.col("size"), t.alias("turn")))
    if last is not None:
        sent = sent.crossJoin(F.broadcast(last))  # one row
        fits = F.size(F.filter(finishes, lambda x: x < F.col("key")))
    else:
        fits = F.lit(repeats)
    return sent.select("doc_id", "src", "size", "n", "source_size", "target", F.when(F.col("size") > 0, fits).otherwise(0).alias("turns"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs (doc_id, text, source)."""
    t = takings(packed(docs, "doc_id", "text", "source"), **options)
    rows = t.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("size") * F.col("turns")).cast("long").alias("taken"), F.col("turns").alias("copies"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, all of their columns, with how often in mix_copies."""
    kept = packed(docs, "doc_id", "text", "source", keep="row")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    kept = kept.select("row", F.col("doc_id").alias("k1"), F.col("source").cast("string").alias("k2"), size.alias("k3")).where("k3 > 0")
    t = takings(packed(docs, "doc_id", "text", "source"), **options).where("turns > 0").select("doc_id", "src", "size", "turns")
    out = kept.join(t, F.col("k1").eqNullSafe(F.col("doc_id")) & F.col("k2").eqNullSafe(F.col("src")) & (F.col("k3") == F.col("size")))
    names = [c for c in docs.columns if c != "mix_copies"]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("turns").cast("long").alias("mix_copies"))
