"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components become integers, floor(scale * x). An index block holds the distinct vectors of a run of
rows as postings: for each component its vectors in the order of their values, cut into segments of
equal quantised value. The impact of a segment on a query is its quantised value times the query's
component, less the least such product of the component, so that no impact is negative. Segments are
worked off by descending impact, a level at a time; each posting adds its impact to its vector's
accumulator. What a vector can still get is bounded by the greatest open impact of each component
whose segment of that vector is open, and by what quantising can hide. A vector is given up, or a whole
block left, only on proof that k others score higher; what is left is rescored exactly.

Queries are taken in waves of bounded bytes that every task sees, against all rows in blocks; each
task keeps the k best of each query over its blocks, and these are merged by query.

Defined results: vectors that are null, or hold null or components that aren't finite once scaled, take
no part. Only vectors of as many components as the query's are its candidates; those of none score 0.
Rows with the query's own id are not its candidates; ties go to the smaller id. Repeated rows are
candidates of their own; an id that stands in several rows asks once for each length of vector, with
the greatest one. Rows without id take no part. Components of any size count as they are; only a score
beyond 64 bits is given as the greatest or least such number. Columns other than the two don't matter,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, packed

SCALE, BLOCK = 256, 4096
#: Bytes of a wave of queries: the driver and every task hold them.
WAVE_BYTES = 64 << 20
#: Bits that quantising leaves out, and the shares of a block's postings that are worked off before each proof is tried.
SHIFT, SHARES = 2, (0.55, 0.75, 0.9, 1.0)
#: Queries of a wave against which each query gets its first k scores: any k others bound its k-th best from below.
PIVOTS = 2048


def integers(column: pa.Array, scale: int = SCALE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, floor(scale * x) of their vectors, as whole floats) for each length of vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(scale * values)
    length = np.diff(offsets)
    valid = np.asarray(column.is_valid())
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    valid &= bad[offsets[1:]] == bad[offsets[:-1]]
    for n in np.unique(length[valid]):
        rows = np.flatnonzero(valid & (length == n))
        yield rows, values[offsets[rows][:, None] + np.arange(n)] + 0.0  # no negative zero


def blocks(vectors: DataFrame, size: int = BLOCK) -> DataFrame:
    """dim, ids, m (the vectors as whole floats) of runs of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, m = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([m.astype("<f8").tobytes()], pa.binary())], ["dim", "ids", "m"])

        for b in batches:
            ids = b.column("vec_id").to_numpy(zero_copy_only=False)
            for rows, m in integers(b.column("embedding")):
                dim = m.shape[1]
                for i in range(0, len(rows), size):
                    held.setdefault(dim, []).append((ids[rows[i : i + size]], m[i : i + size]))
                    if sum(len(x) for x, _ in held[dim]) >= size:
                        yield out(dim)
        for dim in list(held):
            yield out(dim)

    return vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "dim int, ids binary, m binary")


def _unpack(dim: int, ids: bytes, m: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(m, "<f8").reshape(len(ids), dim)


def _once(ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One vector, the greatest, for each id."""
    order = np.lexsort((*m.T[::-1], ids))
    last = np.append(np.flatnonzero(ids[order][1:] != ids[order][:-1]), len(ids) - 1)
    return ids[order][last], m[order][last]


def _exact(m: np.ndarray) -> np.ndarray:
    """Whole floats of any size as integers."""
    return np.array([int(x) for x in m.ravel()], object).reshape(m.shape)


class Index:
    """Postings of the distinct vectors of a block; each vector has the k + 1 smallest of its ids: no more can be among the k best of a query."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, k: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, m = ids[order], np.ascontiguousarray(m[order])
        first, member = np.zeros(1, np.int64), np.zeros(len(ids), np.int64)
        if m.shape[1]:
            _, first, member = np.unique(m.view(f"V{m.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        self.m = m[first]
        by = np.argsort(member, kind="stable")
        start = np.searchsorted(member[by], np.arange(len(first) + 1))
        self.ids = [ids[by[a : min(b, a + k + 1)]] for a, b in zip(start, start[1:], strict=False)]
        self.top = float(np.abs(self.m).max(initial=0))
        if self.top < 2**52:
            level = np.floor(self.m / (1 << SHIFT)) * (1 << SHIFT)
            #: Quantised values: (vector, component), and by component in ascending order with the vectors they belong to.
            self.level = level
            self.order = np.ascontiguousarray(np.argsort(level, axis=0, kind="stable").T)
            self.sorted = np.ascontiguousarray(np.take_along_axis(self.level.T, self.order, 1))
            #: Segments: component, value and number of postings.
            cut = np.diff(self.sorted, axis=1, prepend=np.nan) != 0
            self.segment, at = np.nonzero(cut)
            self.value = self.sorted[self.segment, at]
            self.length = np.diff(np.flatnonzero(cut.ravel()), append=cut.size)

    def search(self, q: np.ndarray, k: int, floor: float, stats: dict) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, their exact scores) of all vectors that may be among the k best of a query; floor: a score that k others are known to have. stats counts postings, rescored vectors and levels."""
        n, dim = self.m.shape
        if max(self.top, 1) * max(float(np.abs(q).max(initial=0)), 1) * max(dim, 1) >= 2**52:  # too large for exact floating point: all by exact integers
            return np.arange(n), _exact(self.m) @ _exact(q)
        q = q.astype(np.float64)
        rest = (1 << SHIFT) - 1
        base = np.minimum(self.sorted[:, 0] * q, self.sorted[:, -1] * q)
        known = base.sum() + np.minimum(q, 0).sum() * rest  # every vector scores that and its impacts at least
        hidden = np.abs(q).sum() * rest
        impact = self.value * q[self.segment] - base[self.segment]
        by = np.argsort(-impact)
        upto = np.cumsum(self.length[by])
        falling = q < 0  # such a component's impacts fall along its list, others rise
        at = np.zeros(dim, np.int64)  # postings of each component that are done, from the end of high impact
        acc = np.zeros(n)
        rows = np.arange(n)
        for share in SHARES if dim else ():
            level = impact[by[min(np.searchsorted(upto, share * n * dim), len(by) - 1)]]
            done = np.bincount(self.segment, weights=np.where(impact >= level, self.length, 0), minlength=dim).astype(np.int64)
            size = done - at
            begin = np.where(falling, at, n - done)
            vector, gain, i = np.empty(size.sum(), np.int64), np.empty(size.sum()), 0
            for d, x, m, w, low in zip(range(dim), begin.tolist(), size.tolist(), q.tolist(), base.tolist(), strict=True):
                if m:
                    vector[i : i + m] = self.order[d, x : x + m]
                    np.multiply(self.sorted[d, x : x + m], w, out=gain[i : i + m])
                    gain[i : i + m] -= low
                    i += m
            acc += np.bincount(vector, weights=gain, minlength=n)
            at = done
            stats["postings"] += int(size.sum())
            stats["levels"] += 1
            next_ = np.where(falling, np.minimum(done, n - 1), np.maximum(n - 1 - done, 0))
            open_ = np.where(done < n, self.sorted[np.arange(dim), next_] * q - base, 0.0)  # the greatest impact of each component that is still open
            kth = np.partition(acc, n - k - 1)[n - k - 1] + known if n > k else -np.inf
            limit = max(kth, floor)
            rows = rows[acc[rows] + open_.sum() + known + hidden >= limit]
            if len(rows) and open_.any():
                unseen = self.level[rows] * q < level + base
                rows = rows[acc[rows] + unseen.astype(np.float64) @ open_ + known + hidden >= limit]
            if len(rows) * dim <= n * dim - at.sum():  # to rescore them costs less than the open postings
                break
        stats["rescored"] += len(rows)
        return rows, (self.m[rows] @ q).astype(np.int64)


def first_floor(ids: np.ndarray, m: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best of its scores with the first PIVOTS other queries: rows of the table, so that k rows are known to score that."""
    floor = np.full(len(ids), -np.inf)
    pivots, names = m[:PIVOTS], ids[:PIVOTS]
    if len(names) <= k or float(np.abs(m).max(initial=0)) ** 2 * max(m.shape[1], 1) >= 2**52:
        return floor
    for i in range(0, len(ids), 1024):
        scores = m[i : i + 1024] @ pivots.T
        scores[ids[i : i + 1024, None] == names[None, :]] = -np.inf
        floor[i : i + 1024] = np.partition(scores, len(names) - k, axis=1)[:, len(names) - k]
    return floor


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose vec_id is divisible by every."""
    scratch = Scratch()
    spark = vectors.sparkSession
    vectors = packed(vectors, "vec_id", "embedding")
    index = scratch(blocks(vectors), "topk-index")
    asked = vectors.where(F.col("vec_id") % every == 0)
    size = asked.agg(F.sum(8 * (1 + F.greatest(F.lit(0), F.size("embedding").cast("long"))))).first()[0] or 0
    waves = max(1, -(-size // wave_bytes))
    found = None
    for n in range(waves):
        part = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == n)
        rows = blocks(part.coalesce(1) if waves == 1 else part).collect()  # about wave_bytes
        queries: dict[int, list] = {}
        for r in rows:
            queries.setdefault(r["dim"], []).append(_unpack(r["dim"], r["ids"], r["m"]))
        shared = spark.sparkContext.broadcast({d: _once(*(np.concatenate(x) for x in zip(*v, strict=True))) for d, v in queries.items()})

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple[list, np.ndarray]] = {}
            stats = {"postings": 0, "rescored": 0, "levels": 0}
            for b in batches:
                for dim, ids, m in zip(*(b.column(c).to_pylist() for c in ("dim", "ids", "m")), strict=True):
                    if dim not in shared.value:
                        continue
                    own, asked = shared.value[dim]
                    lists, floor = best.get(dim) or best.setdefault(dim, ([[] for _ in own], first_floor(own, asked, k)))
                    block = Index(*_unpack(dim, ids, m), k)
                    for i, q in enumerate(asked):
                        at, scores = block.search(q, k, floor[i], stats)
                        if len(at) > 4 * (k + 1) and scores.dtype != object:
                            cut = np.partition(scores, len(at) - k - 1)[len(at) - k - 1]
                            at, scores = at[scores >= cut], scores[scores >= cut]
                        new = [(-int(s), int(x)) for v, s in zip(at, scores, strict=True) for x in block.ids[v] if x != own[i]]
                        if new:
                            lists[i] = sorted(lists[i] + new)[:k]
                        if len(lists[i]) == k and -lists[i][-1][0] < 2**52:
                            floor[i] = max(floor[i], -lists[i][-1][0])
            for dim, (lists, _) in best.items():
                own = shared.value[dim][0]
                flat = [(int(o), x, max(-(2**63), min(2**63 - 1, -s))) for o, one in zip(own, lists, strict=True) for s, x in one]
                for i in range(0, len(flat), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*flat[i : i + 50_000], strict=True)], ["query_id", "vec_id", "score"])

        one = index.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
        if waves > 1:
            one = scratch(one, "topk-wave")
        found = one if found is None else found.unionByName(one)
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
