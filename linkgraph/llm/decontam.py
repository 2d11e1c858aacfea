"""Benchmark decontamination by winnowing.

Each run of W consecutive K-word shingles keeps its smallest hash (the last of equals), so that
documents and items that share K + W - 1 = 10 words share a kept fingerprint at the same place.
Fingerprints of documents that may be among those of the items (a bitmap of bounded size tells) are
joined with them; what matches is extended to all 10-word windows around it, and these are joined
with the windows of the items as text. Items of fewer than 10 words are one window of their own
length, found by the hash of that many words and confirmed as text.

Defined results: every row is judged by its own text, whatever its doc_id; rows with the same doc_id,
repeated rows and rows without doc_id are rows like any other. A null or empty text has no words and
no hits; an empty benchmark hits nothing. Items without item_id hit words like any other, but are not
counted or named among the items; items with the same item_id are one item of several texts. Ties of
fingerprints are kept at their last place on both sides. Texts of any length are read in whole; the
windows of one text must fit in a task's memory. Columns other than those named don't matter, whatever
their names. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BITMAP_BITS, HOT_KEYS, Scratch, bitmap, has_bit, maybe_in, packed
from .textops import ALNUM, U, Words, chunks, mix, sequence_hash

WINDOW, K = 10, 5
#: Bytes of the items' fingerprints and windows up to which they are broadcast; beyond that they are joined by shuffles.
BROADCAST_BYTES = 32 << 20
RUN = WINDOW - K + 1


def winnow(w: Words) -> np.ndarray:
    """First words of the K-grams that are the smallest (the last of equals) of some RUN consecutive ones of one row."""
    g = w.grams(K)
    n = len(w.hash)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    m = n - WINDOW + 1
    best, at = g[:m].copy(), np.arange(m)
    for j in range(1, RUN):
        less = g[j : j + m] <= best
        best[less] = g[j : j + m][less]
        at[less] = np.flatnonzero(less) + j
    row = w.row_of()
    return np.unique(at[row[:m] == row[WINDOW - 1 :]])


def short_hashes(w: Words, length: int) -> np.ndarray:
    """For each word the hash of so many words from it on, 0 where they leave the row."""
    n = len(w.hash)
    out = np.zeros(n, U)
    if n >= length:
        g = np.full(n - length + 1, U(length), U)
        for j in range(length):
            g = g * U(0xC2B2AE3D27D4EB4F) + w.hash[j : n - length + 1 + j]
        row = w.row_of()
        out[: n - length + 1] = np.where(row[: n - length + 1] == row[length - 1 :], mix(g), U(0))
    return out


def _bit(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> U(20)).astype(np.int64) & (bits - 1)


def item_windows(items: DataFrame) -> DataFrame:
    """id, len (words of the window), win (its text), fps (fingerprints in it, or the window's own hash if it is short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lens, wins, fps = [], [], [], []
            for i, j, buf, offs in chunks(b.column("text")):
                w = Words(buf, offs, ALNUM)
                g, kept = w.grams(K), winnow(w)
                for r in range(w.rows):
                    a, n = int(w.first[r]), int(w.count[r])
                    if n == 0:
                        continue
                    if n < WINDOW:
                        ids.append(b.column("id")[i + r].as_py()), lens.append(n), wins.append(w.text(a, a + n).decode("utf8", "replace"))
                        fps.append([np.uint64(sequence_hash(w.hash[a : a + n])).astype(np.int64)])
                        continue
                    for s in range(a, a + n - WINDOW + 1):
                        at = kept[np.searchsorted(kept, s) : np.searchsorted(kept, s + RUN)]
                        ids.append(b.column("id")[i + r].as_py()), lens.append(WINDOW), wins.append(w.text(s, s + WINDOW).decode("utf8", "replace"))
                        fps.append(g[at].astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lens, pa.int32()), pa.array(wins, pa.string()), pa.array(fps, pa.list_(pa.int64()))], ["id", "len", "win", "fps"])

    return items.select(F.col("item_id").cast("string").alias("id"), F.col("text")).where("text is not null").mapInArrow(run, "id string, len int, win string, fps array<bigint>").distinct()


def _mask(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bitmap of the items' fingerprints as bytes, BITMAP_BITS / 8 at most, and the lengths of short windows."""
    fp = windows.select("len", F.explode("fps").alias("fp")).distinct()
    lens = sorted(r["len"] for r in fp.select("len").where(F.col("len") < WINDOW).distinct().collect())  # nine at most
    count = fp.count()
    bits = 1 << 16
    while bits < 32 * count and bits < BITMAP_BITS:
        bits *= 2
    slot = F.shiftrightunsigned("fp", 20).bitwiseAND(F.lit(bits - 1))
    chunk = 1 << 15
    rows = fp.select(F.floor(slot / chunk).cast("int").alias("c"), (slot % chunk).cast("int").alias("s")).groupBy("c").agg(F.bitmap_construct_agg("s").alias("m")).collect()
    mask = np.zeros(bits // 8, np.uint8)
    for r in rows:
        at = r["c"] * (chunk // 8)
        mask[at : at + chunk // 8] = np.frombuffer(r["m"], np.uint8)[: chunk // 8]
    return mask, lens


def _scan(shared, bits: int, lens: list[int]):
    """Over rows (id, h1, h2, text): one row each (start -1, len its words), and one a fingerprint that may be an item's, with the words around it.

    row is a number of its own for each row: the task's number and a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        mask = shared.value
        number = TaskContext.get().partitionId() << 40
        for b in batches:
            for i, _, buf, offs in chunks(b.column("text")):
                w = Words(buf, offs, ALNUM)
                row = w.row_of()
                rows, starts, sizes, fps = [np.arange(w.rows)], [np.full(w.rows, -1)], [w.count], [np.zeros(w.rows, U)]
                around: list = [None] * w.rows

                def add(at, first, last, length, h, w=w, row=row, out=(rows, starts, sizes, fps), around=around):
                    for x, y in zip(out, (row[at], first - w.first[row[at]], np.full(len(at), length), h[at]), strict=True):
                        x.append(y)
                    around += [w.text(x, y).decode("utf8", "replace") for x, y in zip(first, last, strict=True)]

                g, at = w.grams(K), winnow(w)
                at = at[has_bit(mask, _bit(g[at], bits))]
                if len(at):
                    add(at, np.maximum(w.first[row[at]], at - (WINDOW - K)), np.minimum(w.first[row[at] + 1], at + WINDOW), WINDOW, g)
                for length in lens:
                    h = short_hashes(w, length)
                    at = np.flatnonzero(has_bit(mask, _bit(h, bits)) & (h != 0))
                    if len(at):
                        add(at, at, at + length, length, h)
                take = np.concatenate(rows)
                cols = [b.column(c).take(pa.array(take + i)) for c in ("id", "h1", "h2")]
                cols += [pa.array(take + number), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(np.concatenate(fps).astype(np.int64)), pa.array(around, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "h1", "h2", "row", "start", "len", "fp", "around"])
                number += w.rows

    return run


def hits(docs: DataFrame, items: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, h1, h2, n_words) by row; (row, start, end) of the word ranges hit; (row, id) of items found. h1, h2: 128 bits that tell texts apart."""
    spark = docs.sparkSession
    windows = scratch(item_windows(items), "decon-items")
    mask, lens = _mask(windows)
    shared = spark.sparkContext.broadcast(mask)  # BITMAP_BITS / 8 bytes at most
    told = docs.select(F.col("doc_id").alias("id"), *_text_key(F.col("text")), "text")
    seen = scratch(told.mapInArrow(_scan(shared, 8 * len(mask), lens), "id bigint, h1 bigint, h2 bigint, row bigint, start int, len int, fp bigint, around string"), "decon-seen")
    counts = seen.where("start = -1").select("row", F.col("id").alias("doc_id"), "h1", "h2", F.col("len").cast("long").alias("n_words"))
    size = windows.agg(F.sum(F.length("win") + F.length("id") + 16 * F.size("fps") + 32)).first()[0] or 0
    side = F.broadcast if size <= BROADCAST_BYTES else (lambda x: x)
    prints = windows.select("len", F.explode("fps").alias("fp")).distinct()
    near = seen.where("start >= 0").join(side(prints), ["len", "fp"], "left_semi").withColumn("w", F.split("around", " "))
    long_ = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda x: F.struct((F.col("start") + x).alias("start"), F.array_join(F.slice("w", x + 1, F.lit(WINDOW)), " ").alias("win")))
    short = F.array(F.struct(F.col("start"), F.col("around").alias("win")))
    cut = near.where((F.col("len") < WINDOW) | (F.size("w") >= WINDOW)).select("row", "len", F.explode(F.when(F.col("len") < WINDOW, short).otherwise(long_)).alias("x"))
    cut = cut.select("row", "len", "x.start", "x.win").distinct()
    found = scratch(cut.join(side(windows.select("len", "win").distinct()), ["len", "win"], "left_semi"), "decon-found")
    ranges = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("len")).alias("end"))
    named = windows.where("id is not null").select("len", "win", "id").distinct()
    pairs = found.select("row", "len", "win").distinct().join(side(named), ["len", "win"]).select("row", "id").distinct()
    return counts, ranges, pairs


def _text_key(text) -> list:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs."""
    scratch = Scratch()
    counts, ranges, pairs = hits(packed(docs, "doc_id", "text"), packed(items, "item_id", "text"), scratch)
    before = W.partitionBy("row").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    covered = ranges.withColumn("upto", F.coalesce(F.max("end").over(before), F.lit(0)))
    covered = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "upto"))).cast("long").alias("n_hit"))
    found = pairs.groupBy("row").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("id")), ","), 256).alias("items_sha256"))
    out = counts.join(covered, "row", "left").join(found, "row", "left")
    none = F.sha2(F.lit(""), 256)
    n = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs whose text has no hit, all of their columns."""
    scratch = Scratch()
    counts, ranges, _ = hits(packed(docs, "doc_id", "text"), packed(items, "item_id", "text"), scratch)
    bad = counts.join(ranges.select("row").distinct(), "row", "left_semi").groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).count()
    bad = scratch(bad, "decon-bad")
    n, rows = bad.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    if not n:
        return docs
    h1, h2 = _text_key(docs["text"])
    test = maybe_in(bitmap(bad, "k1", n), docs.sparkSession)(h1)
    may = docs.where(test)
    hot = F.col("count") * HOT_KEYS > F.lit(rows)  # HOT_KEYS texts at most, of 16 bytes each
    for some in (F.broadcast(bad.where(hot)), bad.where(~hot)):
        may = may.join(some, (h1 == some["k1"]) & (h2 == some["k2"]), "left_anti")
    return docs.where(~test).unionByName(may)
