"""Line deduplication over overlapping windows of three lines.

A line is what stands between line feeds, compared by its words in lower case; blank lines belong to
no window. Lines of more than WRAP words are read as the several lines that wrapping them after every
WRAP words gives, so that three lines cover a passage of 50 words though its author put it on one.
Every three consecutive (wrapped) lines of a text make a window. Windows that occur more than once
anywhere are found by their hash; the first occurrence (smallest doc_id, then text digest, then line)
stays, and of all later ones the covered lines are merged. A line goes if all of it is covered.

Defined results: null text stays null, empty and blank texts stay as they are. Rows without doc_id are
left as they are, and nothing is the first occurrence there. Repeated rows (the same doc_id and text)
count as one place, so that they stay alike; rows of one doc_id with different texts are places of
their own. Where a window overlaps its own first occurrence, as in a run of equal lines, that one
stays whole: four equal lines keep three. A text all of whose lines are removed becomes empty. Texts
of any length are read in whole; the lines of one text must fit in a task's memory. Columns other
than doc_id, text and n_chars are passed on, whatever their names. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, bitmap, join_counted, maybe_in, packed, split_by_ids
from .textops import SPACED, U, Words, _powers, chunks, mix

LINES, WRAP = 3, 24


class Lines:
    """Lines of a run of rows that aren't blank: row, start and end in the bytes (with the line feed), and their wrapped lines: line, first and last word."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, wrap: int) -> None:
        self.words = w = Words(buf, offs, SPACED)
        cuts = np.union1d(np.flatnonzero(buf == 10) + 1, offs)
        at = np.searchsorted(w.start, cuts)
        full = np.flatnonzero(np.diff(at) > 0)
        self.start, self.end = cuts[full], cuts[full + 1]
        self.row = np.searchsorted(offs, self.start, "right") - 1
        first, count = at[full], at[full + 1] - at[full]
        parts = -(-count // wrap)
        self.line = np.repeat(np.arange(len(full)), parts)
        nth = np.arange(len(self.line)) - np.repeat(np.cumsum(parts) - parts, parts)
        self.first = first[self.line] + nth * wrap
        self.last = np.minimum(self.first + wrap, (first + count)[self.line])
        #: The wrapped lines of each row begin here.
        self.base = np.searchsorted(self.row[self.line], np.arange(len(offs)))


def line_windows(buf: np.ndarray, offs: np.ndarray, wrap: int = WRAP) -> tuple[np.ndarray, ...]:
    """row, first wrapped line and two hashes of each window."""
    found = Lines(buf, offs, wrap)
    word, first, last = found.words.hash, found.first, found.last
    row = found.row[found.line]
    power, inverse = _powers(len(word) + 1)
    s = np.arange(max(0, len(row) - LINES + 1))
    s = s[row[s] == row[s + LINES - 1]]
    hashes = []
    for salt in (U(0), U(0x6A09E667F3BCC909)):
        c = np.zeros(len(word) + 1, U)
        np.cumsum(mix(word + salt) * power[: len(word)], out=c[1:])
        line = mix((c[last] - c[first]) * inverse[first] + (last - first).astype(U))
        h = mix(line[s])
        for j in range(1, LINES):
            h = mix(h * U(0xC2B2AE3D27D4EB4F) + line[s + j])
        hashes.append(h)
    return row[s], s - found.base[row[s]], *hashes


def windows(docs: DataFrame, wrap: int) -> DataFrame:
    """id, t (the text's digest), start, h1, h2 of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, buf, offs in chunks(b.column("text")):
                row, start, h1, h2 = line_windows(buf, offs, wrap)
                rows = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("t").take(rows), pa.array(start.astype(np.int32)), pa.array(h1.astype(np.int64)), pa.array((h2 >> U(32)).astype(np.uint32).view(np.int32))], ["id", "t", "start", "h1", "h2"])

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("t"), "text")
    return docs.mapInArrow(run, "id bigint, t bigint, start int, h1 bigint, h2 int")


def later_windows(docs: DataFrame, scratch: Scratch, wrap: int = WRAP) -> DataFrame:
    """k (doc_id), t and gone (ranges of wrapped lines) of the texts that repeat a window that stands before them.

    Windows are counted by partial sums; what a bitmap of the repeated ones lets pass is all that is
    joined. Windows that hold a large share of the rows are joined by a bounded broadcast.
    """
    every = scratch(windows(docs, wrap), "line-windows")
    repeated = scratch(every.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "line-repeated")
    may = maybe_in(bitmap(repeated, "h1", repeated.count()), docs.sparkSession)
    again = scratch(join_counted(every.where(may(F.col("h1"))), repeated, ["h1", "h2"], "n"), "line-again")
    # a place counts once however often its row stands in the table
    first = again.groupBy("h1", "h2").agg(F.min(F.struct("id", "t", "start")).alias("first"), F.count("*").alias("n"))
    first = scratch(first.select("h1", "h2", "n", F.col("first.id").alias("fid"), F.col("first.t").alias("ft"), F.col("first.start").alias("fstart")), "line-first")
    at_home = (F.col("id") == F.col("fid")) & (F.col("t") == F.col("ft"))
    later = join_counted(again, first, ["h1", "h2"], "n").where(~(at_home & (F.col("start") == F.col("fstart"))))
    begin = F.when(at_home, F.greatest("start", F.col("fstart") + LINES)).otherwise(F.col("start"))
    return later.groupBy(F.col("id").alias("k"), "t").agg(F.collect_set(F.struct(begin.alias("start"), (F.col("start") + LINES).alias("end"))).alias("gone"))


def _cut(buf: np.ndarray, offs: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray, wrap: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts of the rows without the lines that the ranges of wrapped lines (row, start, end) cover, how many lines they had, how many of these went."""
    found = Lines(buf, offs, wrap)
    n = len(offs) - 1
    cover = np.zeros(len(found.line) + 1, np.int64)
    np.add.at(cover, found.base[row] + start, 1)
    np.add.at(cover, found.base[row] + end, -1)
    open_ = np.bincount(found.line[np.cumsum(cover)[:-1] == 0], minlength=len(found.start))
    gone = np.flatnonzero(open_ == 0)
    lines, removed = np.bincount(found.row, minlength=n), np.bincount(found.row[gone], minlength=n)
    edge = np.zeros(len(buf) + 1, np.int64)
    np.add.at(edge, found.start[gone], 1)
    np.add.at(edge, found.end[gone], -1)
    keep = np.cumsum(edge)[:-1] == 0
    ends_text = gone[found.end[gone] == offs[found.row[gone] + 1]]
    for r in np.unique(found.row[ends_text]):  # the last line went: what precedes it loses its line feed
        left = np.flatnonzero(keep[offs[r] : offs[r + 1]])
        if len(left) and buf[offs[r + 1] - 1] != 10 and buf[offs[r] + left[-1]] == 10:
            keep[offs[r] + left[-1]] = False
    for r in np.flatnonzero((removed == lines) & (removed > 0)):
        keep[offs[r] : offs[r + 1]] = False
    at = np.concatenate([[0], np.cumsum(keep)])[offs].astype(np.int32)
    return pa.StringArray.from_buffers(n, pa.py_buffer(at.tobytes()), pa.py_buffer(buf[keep].tobytes())), lines, removed


def dedup_lines(docs: DataFrame, wrap: int = WRAP) -> DataFrame:
    """All columns of docs (doc_id, text): text without repeated windows, n_chars (where there is one) its length; and at the end n_lines, n_removed in the struct _lines."""
    scratch = Scratch()
    gone = scratch(later_windows(packed(docs, "doc_id", "text"), scratch, wrap), "line-gone")
    sure, may = split_by_ids(docs, gone)
    names = docs.columns
    kept = may.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("k"), F.xxhash64("text").alias("t"))
    hit = kept.join(gone, ["k", "t"], "left").select("row", F.col("gone.start").alias("start"), F.col("gone.end").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, start, end = b.column("row").field("text"), b.column("start"), b.column("end")
            for i, j, buf, offs in chunks(text):
                s, e = start.slice(i, j - i), end.slice(i, j - i)
                row = np.repeat(np.arange(j - i), pc.fill_null(pc.list_value_length(s), 0).to_numpy())
                new, n, removed = _cut(buf, offs, row, s.flatten().to_numpy(), e.flatten().to_numpy(), wrap)
                new = pc.if_else(text.slice(i, j - i).is_valid(), new, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([b.column("row").slice(i, j - i), new, pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64))], ["row", "new", "n", "removed"])

    done = hit.mapInArrow(run, StructType([hit.schema["row"], StructField("new", StringType()), StructField("n", LongType()), StructField("removed", LongType())]))

    def column(c: str):
        old = F.col(f"row.`{c}`")
        if c == "text":
            return F.col("new").alias(c)
        if c == "n_chars" and docs.schema[c].dataType.simpleString() in ("int", "bigint"):
            return F.when(F.col("removed") > 0, F.length("new").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    done = done.select(*map(column, names), F.struct("n", "removed").alias("_lines"))
    lines = F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t\r\x0b\x0c]"))), F.lit(0)).cast("long")
    return sure.select("*", F.struct(lines.alias("n"), F.lit(0).cast("long").alias("removed")).alias("_lines")).unionByName(done)
