"""MinHash near-duplicates by an LSH forest.

A text's set holds its distinct word shingles. Texts with the same set are one class. The MinHash
signature of a class is read in TREES orders; each order is one tree of the forest: all classes
sorted by their signature in that order. Two classes are candidates in a tree if they share at least
DEPTH leading columns and stand next to each other, or a few places apart: those are the ones with
the longest common prefix, so that a region is read as deep as the sort tells its classes apart. The
sort is by ranges that may cut a region at any row, so a region of any size is spread over tasks, and
the rows at the cuts are stitched.

Candidates are confirmed on the full sets. The first round tests the best candidate of each class,
the second all neighbours up to NEAR places apart whose ends are not in one component yet; so a group
of many near copies costs a few tests a document. Regions of NEAR + 1 classes have then been compared
in full. A region of more, with several components left in it, is too dense for signatures: its
classes are read by their rarest shingles instead. Two sets that may be linked share one of the rarest
of each (the prefix of a set of n holds n - ceil(0.8 n) + 1), so the lists of classes by rare shingle
hold all that is open. Classes of one list and different components are compared by bounds that no
link can break (sizes, places, parity of the sets), and those that pass are confirmed, the closest
ones first, until none is left; there is no cap on partners. Long lists are met in blocks. A link is
missed only if its ends share no region (3 in a million at the limit of 0.8) and no chain of other
links joins them.

Defined results: null, empty and blank texts have no set and are linked with nothing. Rows with the
same doc_id are one document for the components: what any of them is linked with belongs to its group,
and all of them have one component. Rows without doc_id are linked with nothing and are kept. Equal texts are one
class whatever their number; ties between candidates go to the smaller class. Texts of any length
are read in whole; a text's shingles must fit in a task's memory. Columns other than doc_id and text
don't matter, whatever their names. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.components import components
from .common import Scratch, bitmap, join_counted, maybe_in, packed, split_by_ids
from .textops import SPACED, U, Words, chunks, mix, shingle_sets

#: Words of a shingle where nothing else is asked for, and the least similarity of a link.
SHINGLE, PERCENT = 5, 80
TREES, DEPTH, DEEPER = 24, 4, 4
#: A pair at the limit of 0.8 shares the first DEPTH columns in some tree but for (1 - 0.8**4) ** 24 = 3e-6 of the cases.
NEAR = 3
#: Classes of one posting list of a rare shingle that meet in one block of the closing join, words of 64 bits of parity of a set,
#: and candidates of a class in a slice that the first closing round tests.
BLOCK, PARITY, FIRST = 4096, 16, 4
#: Pairs of a slice of that join, and how many of them are held against the bounds at once.
SLICE, AT_ONCE = 1 << 20, 1 << 16
_rng = np.random.default_rng(20240611)
_MUL = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, np.uint64)
#: The columns after the first DEPTH of each tree.
_DEEP = np.array([_rng.permutation([c for c in range(TREES * DEPTH) if c // DEPTH != t])[:DEEPER] for t in range(TREES)])


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of each hash function over a set of shingle hashes."""
    low = np.full(len(_MUL), np.iinfo(np.uint64).max, U)
    for i in range(0, len(s), 512):
        low = np.minimum(low, (s[i : i + 512, None] * _MUL + _ADD).min(0))
    return (mix(low) & U(0xFFFF)).astype(np.uint64)


def _keys(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each tree its first DEPTH columns and its next ones, as 64-bit integers."""
    head = np.zeros(TREES, U)
    tail = np.zeros(TREES, U)
    by_tree = sig.reshape(TREES, DEPTH)
    for d in range(DEPTH):
        head = head << U(16) | by_tree[:, d]
        tail = tail << U(16) | sig[_DEEP[:, d]]
    return head.astype(np.int64), tail.astype(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets of shingles apart."""
    return int(s.sum(dtype=U)), int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, n (shingles), d1 and d2 (digest of the set), heads, tails (keys of the trees)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d, heads, tails = [], [], [], []
            for _, _, buf, offs in chunks(b.column("text")):
                for s in shingle_sets(Words(buf, offs, SPACED), k):
                    n.append(len(s))
                    d.append(digest(s))
                    h, t = _keys(signature(s)) if len(s) else (np.zeros(0, np.int64),) * 2
                    heads.append(h), tails.append(t)
            digests = np.array(d, np.uint64).astype(np.int64).reshape(-1, 2)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists(heads), lists(tails)], ["id", "n", "d1", "d2", "heads", "tails"])

    return docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(run, "id bigint, n bigint, d1 bigint, d2 bigint, heads array<bigint>, tails array<bigint>")


_PAIRS = "kind int, a bigint, b bigint, tree int, head bigint, place int, part int, ca bigint, cb bigint"


def _neighbours(near: int):
    """Over rows (tree, head, tail, id, comp) sorted within a part: pairs of a row and the near ones after it in its region, if of another component; and the rows at the part's ends."""

    def emit(out: list, tree, head, ids, comp, i, j):
        differ = comp[i] != comp[j]
        i, j = i[differ], j[differ]
        if len(i):
            out.append((np.zeros(len(i), np.int32), ids[i], ids[j], tree[i], head[i], np.zeros(len(i), np.int32), comp[i], comp[j]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tail: list[np.ndarray] | None = None
        place, first = 0, []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("tree", "head", "id", "comp")]
            old = len(tail[0]) if tail else 0
            cols = [np.concatenate([t, c]) for t, c in zip(tail, cols, strict=True)] if tail else cols
            tree, head, ids, comp = cols
            out: list = []
            for step in range(1, near + 1):
                j = np.arange(max(old, step), len(ids))
                i = j - step
                same = (tree[i] == tree[j]) & (head[i] == head[j])
                emit(out, tree, head, ids, comp, i[same], j[same])
            if len(first) < near:
                take = slice(old, old + near - len(first))
                first += [(place + k, *row) for k, row in enumerate(zip(*(c[take].tolist() for c in cols), strict=True))]
            place += len(ids) - old
            tail = [c[-near:] for c in cols]
            if out:
                k = [np.concatenate(x) for x in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k[0]), pa.array(k[1]), pa.array(k[2]), pa.array(k[3].astype(np.int32)), pa.array(k[4]), pa.array(k[5]), pa.array(np.full(len(k[0]), part, np.int32)), pa.array(k[6]), pa.array(k[7])], schema=_SCHEMA)
        if tail:
            ends = {p: r for p, *r in first} | {place - len(tail[0]) + k: list(r) for k, r in enumerate(zip(*(c.tolist() for c in tail), strict=True))}
            rows = [(1, r[2], r[3], r[0], r[1], p, part, r[3], r[3]) for p, r in sorted(ends.items())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [f.type for f in _SCHEMA], strict=True)], schema=_SCHEMA)

    return run


_SCHEMA = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("tree", pa.int32()), ("head", pa.int64()), ("place", pa.int32()), ("part", pa.int32()), ("ca", pa.int64()), ("cb", pa.int64())])


def candidates(rows: DataFrame, near: int, scratch: Scratch) -> DataFrame:
    """a < b, votes (trees in which they are neighbours) of classes of different components."""
    from pyspark.sql import Window as W

    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, "tree", "head", "tail", "id").sortWithinPartitions("tree", "head", "tail", "id")
    out = scratch(dealt.mapInArrow(_neighbours(near), _PAIRS), "lsh-pairs")
    inner = out.where("kind = 0").select("a", "b", "tree")
    # at the cuts: 2 * near rows a part and no more; neighbours within one part were seen there
    w = W.partitionBy("tree", "head").orderBy("part", "place")
    ends = out.where("kind = 1").select("tree", "head", "part", "place", F.col("a").alias("id"), F.col("b").alias("comp"))
    stitched = None
    for step in range(1, near + 1):
        x = ends.select("tree", F.lag("id", step).over(w).alias("a"), F.col("id").alias("b"), F.lag("part", step).over(w).alias("p"), "part", F.lag("comp", step).over(w).alias("c"), "comp").where("a is not null and p != part and c != comp").select("a", "b", "tree")
        stitched = x if stitched is None else stitched.union(x)
    pairs = inner.union(stitched).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "tree")
    return pairs.groupBy("a", "b").agg(F.countDistinct("tree").alias("votes"))


def with_digests(rows: DataFrame, k: int) -> DataFrame:
    """The rows (any columns, text among them) with n, d1 and d2 of their texts in front of a struct of the row."""
    kept = rows.select(F.struct("*").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(len(s), *digest(s)) for _, _, buf, offs in chunks(b.column("row").field("text")) for s in shingle_sets(Words(buf, offs, SPACED), k)]
            cols = np.array(found, np.uint64).astype(np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), b.column("row")], ["n", "d1", "d2", "row"])

    return kept.mapInArrow(run, StructType([*(StructField(c, LongType()) for c in ("n", "d1", "d2")), kept.schema["row"]]))


def confirm(pairs: DataFrame, texts: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """a, b, ok of each pair, by the full sets of both texts (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = ([s for _, _, buf, offs in chunks(b.column(c)) for s in shingle_sets(Words(buf, offs, SPACED), k)] for c in ("ta", "tb"))
            ok = []
            for x, y in zip(left, right, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    one = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return scratch(both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, ok boolean"), "lsh-tested")


def _shingles_of(texts: DataFrame, k: int) -> DataFrame:
    """id, n, tokens (the distinct shingles) and bits (how many shingles fall on each bit, mod 2) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for _, _, buf, offs in chunks(b.column("text")):
                sets = shingle_sets(Words(buf, offs, SPACED), k)
                n = np.array([len(s) for s in sets], np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(sets).astype(np.int64)))
                bits = [np.packbits((np.bincount((s % U(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1).astype(np.uint8)).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(at, len(sets)), pa.array(n), tokens, pa.array(bits, pa.binary())], ["id", "n", "tokens", "bits"])
                at += len(sets)

    return texts.select("id", "text").mapInArrow(run, "id bigint, n bigint, tokens array<bigint>, bits binary")


def _meet(most: int):
    """Over the rows of one bin of posting lists, or of two blocks of one list: pairs of different components that no bound excludes; of each class the closest ones, `most` of a slice, and whether more were there."""

    def closest(p: np.ndarray, q: np.ndarray, apart: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(p), bool)
        for side in (p, q):
            by = np.lexsort((apart, side))
            keep[by[np.arange(len(p)) - np.searchsorted(side[by], side[by]) < most]] = True
        return keep

    def run(t: pa.Table) -> pa.Table:
        token, ids, comp, n, place, block = (t.column(c).to_numpy() for c in ("token", "id", "comp", "n", "place", "block"))
        bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, PARITY)
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        order = np.lexsort((ids, n, token))  # of two rows of a list the first is the smaller set
        token, ids, comp, n, place, block, bits = (x[order] for x in (token, ids, comp, n, place, block, bits))
        first_few = place <= n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1
        end = np.searchsorted(token, token, "right")
        out: list = []

        def passing(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ok = (comp[p] != comp[q]) & first_few[p] & (100 * n[p] >= PERCENT * n[q])
            ok &= 1 + np.minimum(n[p] - place[p], n[q] - place[q]) >= -(-PERCENT * (n[p] + n[q]) // (100 + PERCENT))
            p, q = p[ok], q[ok]
            limit = (100 - PERCENT) * (n[p] + n[q]) // (100 + PERCENT)
            apart = np.zeros(len(p), np.int64)
            for w in range(0, PARITY, 4):
                apart += np.bitwise_count(bits[p, w : w + 4] ^ bits[q, w : w + 4]).sum(1, dtype=np.int64)
                good = apart <= limit
                p, q, limit, apart = p[good], q[good], limit[good], apart[good]
            return p, q, apart

        def bound(p: np.ndarray, q: np.ndarray) -> None:
            found = [passing(p[c : c + AT_ONCE], q[c : c + AT_ONCE]) for c in range(0, len(p), AT_ONCE)]
            p, q, apart = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (p, q, p)
            if len(p):
                keep = closest(p, q, apart)
                out.append((ids[p[keep]], ids[q[keep]], np.full(int(keep.sum()), not keep.all())))

        if i < 0:
            p, step, held, size = np.arange(len(ids), dtype=np.int32), 0, [], 0
            while len(p):
                step += 1
                p = p[p + step < end[p]]
                held.append((p, p + step))
                size += len(p)
                if len(p) and size < SLICE:
                    continue
                bound(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        else:
            left, right = (np.flatnonzero(block == x).astype(np.int32) for x in (i, j))
            for c in range(0, len(left), 256):
                p, q = np.repeat(left[c : c + 256], len(right)), np.tile(right, len(left[c : c + 256]))
                bound(*((p[p < q], q[p < q]) if i == j else (np.minimum(p, q), np.maximum(p, q))))
        a, b, more = (np.concatenate(k) for k in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "more": more})

    return run


class Dense:
    """The classes of the regions that neighbours leave open, by their rarest shingles.

    Every order of the shingles that is the same for all sets would do; here the rarest come first. Of
    two sets that may be linked the larger one, of n, has the first shingle they share among its first
    n - ceil(0.8 n) + 1, the smaller one, of m, among its first m - ceil(8/9 m) + 1.
    """

    def __init__(self, here: DataFrame, texts: DataFrame, k: int, scratch: Scratch) -> None:
        by_comp = here.groupBy("tree", "head", "comp").count()
        regions = by_comp.groupBy("tree", "head").agg(F.sum("count").alias("m"), F.count("*").alias("comps")).where((F.col("comps") > 1) & (F.col("m") > NEAR + 1))
        ids = scratch(here.join(regions.select("tree", "head"), ["tree", "head"], "left_semi").select("id").distinct(), "lsh-open")
        self.scratch, self.any = scratch, ids.limit(1).count() > 0
        if not self.any:
            return
        self.sets = scratch(_shingles_of(texts.join(ids, "id"), k), "lsh-sets")
        every = self.sets.select("id", "n", F.explode("tokens").alias("token"))
        often = scratch(every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1").withColumn("rows", F.col("df")), "lsh-often")
        # shingles of one class can't match, but they take the first places
        ranked = join_counted(every, often, ["token"], "rows").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
        single = F.col("n") - F.size("tokens")
        longest = F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1
        ranked = ranked.select("id", "n", single.alias("single"), F.slice("tokens", F.lit(1), F.greatest(F.lit(0), longest - single).cast("int")).alias("tokens"))
        prefix = ranked.select("id", "n", "single", F.posexplode("tokens").alias("at", "t"))
        self.prefix = scratch(prefix.select("id", "n", F.col("t.token").alias("token"), (F.col("single") + F.col("at") + 1).alias("place")), "lsh-prefix")

    def pairs(self, comp: DataFrame | None, most: int) -> DataFrame:
        """a < b, more: pairs of classes of different components that share a rare shingle and that no bound excludes, the closest of each class; more if a slice held others.

        Lists of up to BLOCK classes share bins; longer ones are cut into blocks, and each two of them meet.
        """
        rows = self.prefix
        if comp is not None:
            rows = rows.join(comp.select("id", "component"), "id", "left")
        rows = self.scratch(rows.withColumn("comp", F.coalesce("component", "id") if comp is not None else F.col("id")), "lsh-rows")
        lists = rows.groupBy("token").agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token", "rows")
        lists = self.scratch(lists.select("token", "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks")), "lsh-lists")
        bins = F.lit((lists.where("blocks = 1").agg(F.sum("rows")).first()[0] or 0) // BLOCK + 1)
        rows = join_counted(rows, lists, ["token"], "rows").join(self.sets.select("id", "bits"), "id")
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        one = F.col("blocks") == 1
        cells = rows.select("token", "id", "comp", "n", "place", "block", "blocks", "bits", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
        cells = cells.select("token", "id", "comp", "n", "place", "block", "bits", F.when(one, F.pmod(F.xxhash64("token"), bins)).otherwise(F.col("token")).alias("g"), F.when(one, -1).otherwise(F.least("block", "o")).alias("i"), F.when(one, -1).otherwise(F.greatest("block", "o")).alias("j"))
        met = cells.groupBy("g", "i", "j").applyInArrow(_meet(most), "a bigint, b bigint, more boolean")
        return self.scratch(met.groupBy("a", "b").agg(F.bool_or("more").alias("more")), "lsh-met")


def _with_components(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The rows (tree, head, tail, id) with comp, the component of id, itself if it has no link."""
    if comp is None:
        return rows.withColumn("comp", F.col("id"))
    c = comp.select(F.col("id").alias("_i"), "component")
    return rows.join(c, rows["id"] == c["_i"], "left").select("tree", "head", "tail", "id", F.coalesce("component", "id").alias("comp"))


def class_components(same: DataFrame, docs: DataFrame, k: int, scratch: Scratch, repeated: bool, links: DataFrame | None) -> DataFrame | None:
    """id, component of the classes that have a link, among the classes same (cid, rep, n, d1, d2, heads, tails) of docs (doc_id, text); links: those known beforehand."""
    from pyspark.sql import Window as W

    comp = components(links, scratch) if links is not None else None
    trees = same.select("cid", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.lit(TREES - 1)).alias("tree"), "heads", "tails")).alias("x"))
    trees = trees.select(F.col("x.tree").alias("tree"), F.col("x.heads").alias("head"), F.col("x.tails").alias("tail"), F.col("cid").alias("id"))
    # only classes that share a region can be linked
    shared = trees.groupBy("tree", "head").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("tree", "head")
    rows = scratch(trees.join(shared, ["tree", "head"], "left_semi"), "lsh-forest")
    involved = scratch(same.join(rows.select(F.col("id").alias("cid")).distinct(), "cid", "left_semi").select("cid", F.col("rep").alias("doc_id"), "n", "d1", "d2"), "lsh-involved")
    n = involved.count()
    if not n:
        return comp
    may = maybe_in(bitmap(involved, "doc_id", n), docs.sparkSession)
    texts = with_digests(docs.where("doc_id is not null").where(may(F.col("doc_id"))), k)
    texts = texts.select("n", "d1", "d2", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text")).join(involved, ["doc_id", "n", "d1", "d2"]).select(F.col("cid").alias("id"), "text")
    texts = scratch(texts.dropDuplicates(["id"]) if repeated else texts, "lsh-texts")
    tested = None

    def test(pairs: DataFrame) -> None:
        nonlocal tested, links, comp
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        done = confirm(pairs, texts, k, scratch)
        new = done.where("ok").select("a", "b")
        tested = done.select("a", "b") if tested is None else tested.unionByName(done.select("a", "b"))
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            comp = components(links, scratch)

    best = W.partitionBy("b").orderBy(F.col("votes").desc(), "a")
    first = candidates(_with_components(rows, comp), 1, scratch)
    test(first.withColumn("k", F.row_number().over(best)).where("k = 1"))
    test(candidates(_with_components(rows, comp), NEAR, scratch))
    dense = Dense(_with_components(rows, comp), texts, k, scratch)
    most, more = FIRST, dense.any
    while more:
        pairs = dense.pairs(comp, most)
        more = pairs.where("more").limit(1).count() > 0
        test(pairs)
        most *= 8
    return comp


def classes(docs: DataFrame, k: int, by_id: bool, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(id, n, d1, d2 for each row of docs (doc_id, text); n, d1, d2, rep, component, first_n, first_d1, first_d2, copies for each class of documents with an id).

    rep is the smallest doc_id of the class, component that of its group, and first_ the class that
    stands for the group: of those that hold that document, the one with the smallest digest. With
    by_id, classes that hold rows of one document belong to one group.
    """
    sketch = scratch(sketches(docs, k), "lsh-sketch")
    real = sketch.where("n > 0 and id is not null")
    same = real.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.any_value("heads").alias("heads"), F.any_value("tails").alias("tails"))
    same = scratch(same.withColumn("cid", F.monotonically_increasing_id()), "lsh-classes")
    repeated = real.select("id", "n", "d1", "d2").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").limit(1).count() > 0
    links = None
    if repeated and by_id:
        mine = real.select("id", "n", "d1", "d2").distinct().join(same.select("n", "d1", "d2", "cid"), ["n", "d1", "d2"]).select("id", "cid")
        low = mine.groupBy("id").agg(F.min("cid").alias("low"), F.max("cid").alias("high")).where("low < high")
        links = scratch(mine.join(low, "id").where("cid != low").select(F.col("low").alias("a"), F.col("cid").alias("b")).distinct(), "lsh-ids")
        links = links if links.limit(1).count() else None
    comp = class_components(same, docs, k, scratch, repeated, links)
    held = same.select("cid", "n", "d1", "d2", "rep", "copies")
    if comp is None:
        group = F.col("cid")
    else:
        held = held.join(comp.select(F.col("id").alias("cid"), "component"), "cid", "left")
        group = F.coalesce("component", "cid")
    held = scratch(held.select("n", "d1", "d2", "rep", "copies", group.alias("g")), "lsh-held")
    least = scratch(held.groupBy("g").agg(F.min(F.struct("rep", "n", "d1", "d2")).alias("first"), F.count("*").alias("members")), "lsh-groups")
    out = join_counted(held, least, ["g"], "members")
    return sketch, scratch(out.select("n", "d1", "d2", "rep", F.col("first.rep").alias("component"), F.col("first.n").alias("first_n"), F.col("first.d1").alias("first_d1"), F.col("first.d2").alias("first_d2"), "copies"), "lsh-done")


def row_components(sketch: DataFrame, found: DataFrame) -> DataFrame:
    """id, n and component of each row: rows without words have that of the other rows of their document, or their own id."""
    real = sketch.where("n > 0 and id is not null").select("id", "n", "d1", "d2")
    done = join_counted(real, found.select("n", "d1", "d2", "component", "copies"), ["n", "d1", "d2"], "copies").select("id", "n", "component")
    bare = sketch.where("n = 0 and id is not null").select("id", "n")
    known = done.join(bare.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("component").alias("component"))
    bare = bare.join(known, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return done.unionByName(bare).unionByName(sketch.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of its group) and kept (it is that one)."""
    out = row_components(*classes(packed(docs, "doc_id", "text"), shingle, True, Scratch()))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("id").isNull() | (F.col("id") == F.col("component"))).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stand for their group: one row a group, rows without words or doc_id all.

    Groups are of texts here: a text that resembles no other stays, though another row has its doc_id.
    The row that stays is one of the group's smallest doc_id, of that one's text with the smallest
    digest, and of rows alike in these the first by their JSON, so that reruns agree.
    """
    scratch = Scratch()
    sketch, found = classes(packed(docs, "doc_id", "text"), shingle, False, scratch)
    first = (F.col("n") == F.col("first_n")) & (F.col("d1") == F.col("first_d1")) & (F.col("d2") == F.col("first_d2"))
    keep = scratch(found.where(first).select("n", "d1", "d2", F.col("rep").alias("id")), "lsh-keep")
    real = sketch.where("n > 0 and id is not null").select("id", "n", "d1", "d2").groupBy("id", "n", "d1", "d2").count()
    told = scratch(real.join(keep.withColumn("stays", F.lit(True)), ["id", "n", "d1", "d2"], "left").where("stays is null or count > 1"), "lsh-told")
    sure, may = split_by_ids(docs, scratch(told.select(F.col("id").alias("k")).distinct(), "lsh-out"))
    rows = with_digests(may, shingle).withColumn("id", F.col("row.doc_id").cast("long"))
    told = told.select("id", "n", "d1", "d2", F.coalesce("stays", F.lit(False)).alias("stays"))
    rows = scratch(rows.join(told, ["id", "n", "d1", "d2"], "left").where("stays is null or stays"), "lsh-kept")
    alone = rows.where("stays is null").select("row.*")
    many = rows.where("stays").groupBy("id", "n", "d1", "d2").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*")
    return sure.unionByName(alone).unionByName(many)
