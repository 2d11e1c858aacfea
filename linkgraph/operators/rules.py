"""Linking rules: declarative predicates that derive scored edges between two labels.

A rule is a scored similarity join. Each predicate has its own blocking keys, so that candidates meet
in an equi-join: the key itself, tokens of a prefix that similar sets must share, numeric buckets,
cells of a grid on the sphere, blocks of vectors. All is the least score of its parts and Any the
greatest. A via rule reaches its target over an edge of the source. No rule links a node to itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import family
from ..model import PropertyGraph

EARTH_KM = 6371.0088
LIST_MOST = 512  # elements of a list that KeyMatch looks at
DEEPEST, CHAIN_MOST = 4, 4


class RuleError(ValueError):
    pass


@dataclass(frozen=True)
class KeyMatch:
    field: str


@dataclass(frozen=True)
class FieldEqual:
    field: str


@dataclass(frozen=True)
class Overlap:
    field: str
    min: float


@dataclass(frozen=True)
class NumericWithin:
    field: str
    tolerance: float


@dataclass(frozen=True)
class GeoRadius:
    field: str
    km: float


@dataclass(frozen=True)
class VectorSimilar:
    field: str
    min: float


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any:
    parts: tuple


Predicate = KeyMatch | FieldEqual | Overlap | NumericWithin | GeoRadius | VectorSimilar | All | Any


@dataclass(frozen=True)
class RuleDef:
    name: str
    src_label: str
    dst_label: str
    predicate: Predicate
    edge_type: str
    weight_prop: str | None = None
    max_edges: int | None = None  # of each source, the best; see default_cap
    approximate: bool = False
    via_label: str | None = None
    via_edge: str | None = None
    via_dir: str = "out"
    namespace: str | None = None

    def validate(self) -> RuleDef:
        def check(p, depth: int) -> None:
            if depth > DEEPEST:
                raise RuleError(f"predicates nest {DEEPEST} deep at most")
            if isinstance(p, (All, Any)):
                if not p.parts:
                    raise RuleError("All and Any take a predicate at least")
                for x in p.parts:
                    check(x, depth + 1)
            elif not p.field:
                raise RuleError("a predicate needs a field")
            elif isinstance(p, (Overlap,)) and not 0 <= p.min <= 1 or isinstance(p, VectorSimilar) and not -1 <= p.min <= 1:
                raise RuleError("a least score lies within its range")
            elif isinstance(p, NumericWithin) and not (math.isfinite(p.tolerance) and p.tolerance >= 0) or isinstance(p, GeoRadius) and not (math.isfinite(p.km) and p.km > 0):
                raise RuleError("a distance is finite and positive")

        check(self.predicate, 1)
        if not (self.name and self.src_label and self.dst_label and self.edge_type):
            raise RuleError("a rule needs a name, two labels and an edge type")
        if bool(self.via_label) != bool(self.via_edge) or self.via_dir not in ("out", "in"):
            raise RuleError("a via rule needs a label, an edge type and a direction")
        if self.max_edges is not None and self.max_edges < 1:
            raise RuleError("max_edges is above zero")
        return self


def default_cap(p: Predicate) -> int:
    """What callers that must bound a rule use when they give no max_edges: key matches 512, others 32."""
    return 512 if isinstance(p, KeyMatch) or isinstance(p, (All, Any)) and all(isinstance(x, KeyMatch) for x in p.parts) else 32


def _side(nodes: DataFrame, field: str, name: str) -> DataFrame | None:
    return nodes.select(F.col("key").alias(name), F.col(f"`{field}`").alias("x")).where("x is not null") if field in nodes.columns else None


def _none(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "s string, d string, score double")


def _type(df: DataFrame) -> T.DataType:
    return df.schema["x"].dataType


def _is_numbers(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType) and isinstance(t.elementType, T.NumericType)


# ---- pairs of each predicate: s, d, score -----------------------------------------------------------


def key_match(p: KeyMatch, src: DataFrame, dst: DataFrame) -> DataFrame:
    s = _side(src, p.field, "s")
    if s is None:
        return _none(src)
    t = _type(s)
    if isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
        s = s.select("s", F.explode(F.array_distinct(F.slice("x", 1, LIST_MOST))).alias("x"))
    elif not isinstance(t, T.StringType):
        return _none(src)
    return s.join(dst.select(F.col("key").alias("d")), F.col("x") == F.col("d")).select("s", "d", F.lit(1.0).alias("score"))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, F.least(dot / (norm(a) * norm(b)), F.lit(1.0)))


def _units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their unit vectors) for each length of vector in column x; vectors with a null or infinite component, or without length, are left out."""
    column = batch.column("x")
    offsets, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False).astype(float)
    length = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
    for n in np.unique(length[length > 0]):
        rows = np.flatnonzero(length == n)
        m = values[offsets[rows][:, None] + np.arange(n)]
        norm = np.linalg.norm(m, axis=1)
        ok = np.isfinite(norm) & (norm > 0)
        if ok.any():
            yield rows[ok], m[ok] / norm[ok, None]


# ---- classes: nodes with equal fields are compared once --------------------------------------------------

#: Keys of a class in one row; nodes up to which the classes of a side may be broadcast; cells of a block of sets as 0 and 1.
CHUNK, SENT_NODES, BLOCK_CELLS = 1024, 500_000, 1 << 22


def _parts(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def leaves(p: Predicate) -> list:
    return [y for x in p.parts for y in leaves(x)] if isinstance(p, (All, Any)) else [p]


def plain(p: Predicate) -> bool:
    """Whether the predicate gives the very same score wherever it is computed, from the fields alone."""
    return not any(isinstance(x, (KeyMatch, VectorSimilar)) for x in leaves(p))


def _by_class(p: Predicate) -> bool:
    def ok(x) -> bool:
        return plain(x) if isinstance(x, Any) else all(map(ok, x.parts)) if isinstance(x, All) else not isinstance(x, KeyMatch)

    return ok(p)


def _fits(p: Predicate, s: T.StructType, d: T.StructType) -> bool:
    """Whether both sides have the field of a leaf, in types that it compares."""
    if p.field not in s.names or p.field not in d.names:
        return False
    a, b = s[p.field].dataType, d[p.field].dataType
    if isinstance(p, FieldEqual):
        whole = lambda t: isinstance(t, T.IntegralType)
        return family(a) == family(b) and family(a) not in ("list", "map", "duration") and whole(a) == whole(b)
    if isinstance(p, Overlap):
        return isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType)
    if isinstance(p, NumericWithin):
        return isinstance(a, T.NumericType) and isinstance(b, T.NumericType)
    return _is_numbers(a) and _is_numbers(b)


def score_of(p: Predicate, s: T.StructType, d: T.StructType, a: Column, b: Column) -> Column:
    """The score of two structs of fields, null where the predicate doesn't hold."""
    if isinstance(p, (All, Any)):
        parts = [score_of(x, s, d, a, b) for x in p.parts]
        if len(parts) == 1:
            return parts[0]
        if isinstance(p, Any):
            return F.greatest(*parts)
        ok = F.lit(True)
        for x in parts:
            ok = ok & x.isNotNull()
        return F.when(ok, F.least(*parts))
    if not _fits(p, s, d):
        return F.lit(None).cast("double")
    x, y = a[p.field], b[p.field]
    if isinstance(p, FieldEqual):
        return F.when(x == y, 1.0)
    if isinstance(p, NumericWithin):
        x, y = x.cast("double"), y.cast("double")
        if p.tolerance == 0:
            return F.when(x == y, 1.0)
        gap = F.abs(x - y)
        return F.when(gap <= float(p.tolerance), 1 - gap / float(p.tolerance))
    if isinstance(p, Overlap):
        x, y = (F.array_distinct(F.filter(v, lambda t: t.isNotNull())) for v in (x, y))
        n = F.size(F.array_intersect(x, y))
        score = n / (F.size(x) + F.size(y) - n)
        return F.when((n > 0) & (score >= p.min), score)
    if isinstance(p, GeoRadius):
        ok = F.lit(True)
        for v in (x, y):
            ok = ok & (F.size(v) == 2) & v[0].cast("double").between(-90, 90) & v[1].cast("double").between(-180, 180)
        km = haversine(x[0].cast("double"), x[1].cast("double"), y[0].cast("double"), y[1].cast("double"))
        return F.when(ok & (km <= p.km), 1 - km / p.km)
    return F.when(cosine(x, y) >= p.min, cosine(x, y))


@dataclass(frozen=True)
class Classes:
    """Nodes of one side by equal fields: rows of a struct x of the fields and m, at most about CHUNK of their keys."""

    df: DataFrame
    schema: T.StructType
    nodes: int
    rows: int


def _classes(nodes: DataFrame, fields: list[str]) -> Classes:
    from ..storage import materialize, ship

    ship(nodes.sparkSession)
    have = [f for f in fields if f in nodes.columns]
    base = nodes.select("key", *[F.col(f"`{f}`") for f in have])
    some = F.lit(False)
    for f in have:
        some = some | F.col(f"`{f}`").isNotNull()
    base = materialize(base.where(some), "rule-nodes")
    names = [f"`{f}`" for f in have]
    if not have:
        return Classes(base.select(F.struct(F.array("key").alias("m")).alias("x")), base.schema, 0, 0)
    hot = base.groupBy(*names).agg(F.count("*").alias("_n")).where(F.col("_n") > CHUNK)
    hot = hot.select(*[F.col(f"`{f}`").alias(f"_h{i}") for i, f in enumerate(have)], F.ceil(F.col("_n") / CHUNK).cast("int").alias("_n"))
    on = F.lit(True)
    for i, f in enumerate(have):
        on = on & F.col(f"`{f}`").eqNullSafe(F.col(f"_h{i}"))
    dealt = base.join(F.broadcast(hot), on, "left")  # hot: one row for each CHUNK nodes at most
    dealt = dealt.groupBy(*names, F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("key"), F.col("_n"))).otherwise(0).alias("_part")).agg(F.collect_list("key").alias("_m"))
    made = materialize(dealt.select(F.struct(*[F.col(f"`{f}`") for f in have], F.col("_m").alias("m")).alias("x")), "rule-classes")
    return Classes(made, base.schema, base.count(), made.count())


def _two(src: DataFrame, dst: DataFrame, fields: list[str]) -> tuple[Classes, Classes]:
    s = _classes(src, fields)
    return s, s if src is dst else _classes(dst, fields)


def _leaf_meet(p: Predicate, s: Classes, d: Classes, approximate: bool, cap: int | None = None) -> DataFrame:
    """a, b and score of the classes for which a leaf holds."""
    spark = s.df.sparkSession
    a = s.df.select(F.col("x").alias("a")).where(F.col("a")[p.field].isNotNull() if p.field in s.schema.names else F.lit(False))
    b = d.df.select(F.col("x").alias("b")).where(F.col("b")[p.field].isNotNull() if p.field in d.schema.names else F.lit(False))
    if not _fits(p, s.schema, d.schema):
        return a.join(b, F.lit(True)).where(F.lit(False)).select("a", "b", F.lit(0.0).alias("score"))
    x, y = F.col("a")[p.field], F.col("b")[p.field]
    if isinstance(p, VectorSimilar):
        return _vector_meet(p, s, d, a, b, approximate, cap)
    if isinstance(p, Overlap):
        return _overlap_meet(p, s, d, a, b)
    a = a.repartition(4 * _parts(spark))  # few classes can be many pairs of nodes
    small = d.nodes <= SENT_NODES and d.rows <= 20_000
    if isinstance(p, FieldEqual) or isinstance(p, NumericWithin) and p.tolerance == 0:
        if isinstance(p, NumericWithin):
            x, y = x.cast("double"), y.cast("double")
        met = a.join(F.broadcast(b) if small else b, x == y)
        return met.select("a", "b", F.lit(1.0).alias("score"))
    if isinstance(p, NumericWithin):
        width = float(p.tolerance)
        bucket = lambda c: F.floor(c.cast("double") / width)
        a = a.withColumn("k", F.explode(F.array(*[bucket(x) + i for i in (-1, 0, 1)])))
        b = b.withColumn("k", bucket(y))
    else:
        chord = 2 * math.sin(min(p.km / EARTH_KM, math.pi) / 2) * (1 + 1e-9) + 1e-12
        near = lambda v: (F.size(v) == 2) & v[0].cast("double").between(-90, 90) & v[1].cast("double").between(-180, 180)

        def cell(v: Column) -> Column:
            lat, lon = F.radians(v[0].cast("double")), F.radians(v[1].cast("double"))
            return F.struct(*[F.floor(c / chord).cast("int").alias(n) for n, c in (("cx", F.cos(lat) * F.cos(lon)), ("cy", F.cos(lat) * F.sin(lon)), ("cz", F.sin(lat)))])

        a = a.where(near(x)).withColumn("c", cell(x))
        a = a.withColumn("k", F.explode(F.array(*[F.struct((F.col("c.cx") + i).alias("cx"), (F.col("c.cy") + j).alias("cy"), (F.col("c.cz") + k).alias("cz")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])))
        b = b.where(near(y)).withColumn("k", cell(y))
    if small:
        met = a.join(F.broadcast(b), "k")
    else:  # a few keys can hold all classes: each is cut into parts
        n = max(1, _parts(spark) // 4)
        a = a.withColumn("part", F.pmod(F.xxhash64(F.col("a.m")[0]), F.lit(n)).cast("int"))
        met = a.join(b.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["k", "part"])
    score = score_of(p, s.schema, d.schema, F.col("a"), F.col("b"))
    return met.select("a", "b", score.alias("score")).where("score is not null")


def _meet(p: Predicate, s: Classes, d: Classes, approximate: bool, cap: int | None = None) -> DataFrame:
    """a, b and score of the classes for which the predicate holds, once each. The other parts of All are tested where the classes meet by one of them; of Any, a later part gives only what no earlier one holds for."""
    at = lambda x: score_of(x, s.schema, d.schema, F.col("a"), F.col("b"))
    if isinstance(p, All):
        rank = lambda x: next((i for i, t in enumerate((FieldEqual, VectorSimilar, Overlap, GeoRadius, NumericWithin, All, Any)) if isinstance(x, t)), 9)
        first = min(p.parts, key=rank)
        out = _meet(first, s, d, approximate)
        for x in p.parts:
            if x is not first:
                out = out.withColumn("other", at(x)).where("other is not null").select("a", "b", F.least("score", "other").alias("score"))
        return out
    if isinstance(p, Any):
        out = None
        for i, x in enumerate(p.parts):
            one = _meet(x, s, d, approximate)
            for y in p.parts[:i]:
                one = one.where(at(y).isNull())
            for y in p.parts[i + 1 :]:
                one = one.withColumn("score", F.greatest("score", at(y)))
            out = one if out is None else out.unionByName(one)
        return out
    return _leaf_meet(p, s, d, approximate, cap)


def _spread(met: DataFrame) -> DataFrame:
    """s, d, score of the nodes of classes that met."""
    return met.select("score", F.col("a.m").alias("sm"), F.col("b.m").alias("dm")).select("score", "dm", F.explode("sm").alias("s")).select("s", F.explode("dm").alias("d"), "score")


def _best(met: DataFrame, k: int) -> DataFrame:
    """The k best of each node of classes that met, ties by key: a class needs the k + 1 best of its nodes' common list."""
    each = met.select(F.col("a.m")[0].alias("id"), F.col("a.m").alias("sm"), "score", F.explode(F.slice(F.array_sort("b.m"), 1, k + 1)).alias("d"))
    order = [F.col("score").desc(), F.col("d")]
    each = each.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(*order))).where(F.col("n") <= k + 1)
    each = each.select(F.explode("sm").alias("s"), "d", "score").where("s != d")
    return each.withColumn("n", F.row_number().over(W.partitionBy("s").orderBy(*order))).where(F.col("n") <= k).select("s", "d", "score")


def _nearest(p: NumericWithin, s: Classes, d: Classes, k: int) -> DataFrame:
    """a, b, score: for each class the values next to its own in order, so many that the k + 1 best are among them."""
    from ..storage import materialize

    spark = s.df.sparkSession
    value = lambda v: F.col(v)[p.field].cast("double")
    side = lambda c, v: c.df.select(F.col("x").alias(v)).where(F.col(v)[p.field].isNotNull() & ~F.isnan(value(v)))
    width = float(p.tolerance)
    own = side(s, "a")
    # of a value the k + 1 smallest keys are enough
    few = side(d, "b").select(value("b").alias("v"), F.explode(F.slice(F.array_sort("b.m"), 1, k + 1)).alias("d")).withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("d"))).where(F.col("n") <= k + 1).groupBy("v").agg(F.collect_list("d").alias("m"))
    points = own.select(value("a").alias("v"), F.lit(None).cast("array<string>").alias("m"), "a").unionByName(few.select("v", "m", F.lit(None).cast(own.schema["a"].dataType).alias("a")))
    dealt = materialize(points.repartitionByRange(_parts(spark), "v").withColumn("pid", F.spark_partition_id()), "rule-line")
    line = dealt.withColumn("c", F.count("m").over(W.partitionBy("pid").orderBy("v").rangeBetween(W.unboundedPreceding, 0)))
    before, total = {}, 0
    for r in sorted(dealt.groupBy("pid").agg(F.count("m").alias("n")).collect()):  # one row a partition
        before[r["pid"]], total = total, total + r["n"]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.create_map(F.lit(0), F.lit(0))
    line = materialize(line.withColumn("r", F.col("c") + offset[F.col("pid")]), "rule-ranks")
    ranked = line.where("m is not null").select("r", F.col("v").alias("w"), "m")
    near = k + 2
    while True:
        asked = line.where("a is not null").select("a", "v", F.col("r").alias("at"), F.explode(F.sequence(F.col("r") - near + 1, F.col("r") + near)).alias("r"))
        gap = F.abs(F.col("v") - F.col("w"))
        met = asked.join(ranked, "r").where(gap <= width).select("a", "r", "at", F.struct("m").alias("b"), (1 - gap / width if width else F.lit(1.0)).alias("score"))
        # two gaps can round to one score: then more of that side may tie with the last place
        place = met.withColumn("n", F.row_number().over(W.partitionBy(F.col("a.m")[0]).orderBy(F.col("score").desc()))).withColumn("last", F.max(F.when(F.col("n") == k + 1, F.col("score"))).over(W.partitionBy(F.col("a.m")[0])))
        edge = place.where(((F.col("r") == F.col("at") - near + 1) | (F.col("r") == F.col("at") + near)) & (F.coalesce("last", F.lit(-1.0)) <= F.col("score"))).limit(1).count()
        if not edge or near > total:
            return met.select("a", "b", "score")
        near *= 4


def _vector_meet(p: VectorSimilar, s: Classes, d: Classes, a: DataFrame, b: DataFrame, approximate: bool, cap: int | None) -> DataFrame:
    """Exact: blocks of both sides meet in the cells of a grid that is spread over the tasks, a matrix product for each two. Approximate: sign patterns of random projections, where they compare few enough pairs. cap: only what can be among the best so many of a class in its cell."""
    least = float(p.min)
    if approximate and (shape := hashing(least)):
        ids = _vector_hashed(p, *(x.select(F.col(n)["m"][0].alias(k), F.col(n)[p.field].alias("x")) for x, n, k in ((a, "a", "s"), (b, "b", "d"))), *shape)
        ids = ids.join(a.withColumn("s", F.col("a.m")[0]), "s").join(b.withColumn("d", F.col("b.m")[0]), "d")
        return ids.select("a", "b", "score")
    units = lambda batch: ((rows, m, np.zeros(len(rows))) for rows, m in _units(batch))
    return _dense(a, b, p.field, units, lambda x, y, nx, ny: np.minimum(x @ y.T, 1.0), least, max(s.rows, d.rows), cap)


#: Distinct tokens up to which sets can be compared as rows of a matrix, and what a comparison over shared tokens costs in multiplications of it.
DENSE_TOKENS, TOKEN_COST = 8192, 1500


def _overlap_meet(p: Overlap, s: Classes, d: Classes, a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard of token sets. Few tokens: as bits. Many that most sets share: as matrices, block by block. Else sets of at least min share a token among the rarest n - ceil(min * n) + 1 of each, and meet there."""
    own = lambda v: F.array_distinct(F.filter(v, lambda t: t.isNotNull()))
    tokens = None
    for df, n, side in ((a, "a", "s"), (b, "b", "d")):
        each = df.select(F.col(n)["m"][0].alias("k"), F.lit(side).alias("side"), F.explode(own(F.col(n)[p.field])).alias("t"))
        tokens = each if tokens is None else tokens.unionAll(each)
    if tokens.select("t").distinct().limit(FEW_TOKENS + 1).count() <= FEW_TOKENS:
        return _overlap_bits(p.min, tokens, a, b)
    kind = tokens.schema["t"].dataType
    if isinstance(kind, (T.StringType, T.IntegralType)) and s.schema[p.field].dataType == d.schema[p.field].dataType:
        both = tokens.groupBy("t").agg(F.count_if(F.col("side") == "s").alias("x"), F.count_if(F.col("side") == "d").alias("y"))
        many, shared = both.agg(F.count("*"), F.sum(F.col("x").cast("double") * F.col("y"))).first()
        if many <= DENSE_TOKENS and float(s.rows) * d.rows * many < TOKEN_COST * (shared or 0.0):
            return _overlap_dense(p, s, d, a, b, [r["t"] for r in both.select("t").collect()])
    often = tokens.groupBy("t").agg(F.count("*").alias("n"))
    ordered = tokens.join(often, "t").groupBy("side", "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "t"))), lambda v: v["t"]).alias("ts"))
    size = F.size("ts")
    first = F.slice("ts", F.lit(1), F.least(size, size - F.ceil(F.lit(float(p.min)) * size - 1e-9).cast("int") + 1))
    ordered = ordered.select("side", "k", "ts", first.alias("pre"))
    sides = {n: ordered.where(F.col("side") == n) for n in "sd"}
    x, y = (sides[n].select(F.col("k").alias(n), F.explode("pre").alias("t")) for n in "sd")
    met = x.join(y, "t").select("s", "d").distinct()  # keys only meet; the sets are compared once for each pair
    met = met.join(sides["s"].select(F.col("k").alias("s"), F.col("ts").alias("ss")), "s").join(sides["d"].select(F.col("k").alias("d"), F.col("ts").alias("ds")), "d")
    found = met.select("s", "d", F.size(F.array_intersect("ss", "ds")).alias("n"), (F.size("ss") + F.size("ds")).alias("m"))
    found = found.where("n > 0").select("s", "d", (F.col("n") / (F.col("m") - F.col("n"))).alias("score")).where(F.col("score") >= p.min)
    return found.join(a.withColumn("s", F.col("a.m")[0]), "s").join(b.withColumn("d", F.col("b.m")[0]), "d").select("a", "b", "score")


def _overlap_dense(p: Overlap, s: Classes, d: Classes, a: DataFrame, b: DataFrame, names: list) -> DataFrame:
    block = max(64, min(2048, BLOCK_CELLS // len(names)))

    def units(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        column = batch.column("x")
        known = pa.array(names, type=column.type.value_type)
        for i in range(0, len(column), block):
            part = column.slice(i, block)
            at = pc.index_in(part.flatten(), value_set=known)
            row, ok = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(part), 0).to_numpy()), at.is_valid().to_numpy(zero_copy_only=False)
            m = np.zeros((len(part), len(names)), np.uint8)
            m[row[ok], at.drop_null().to_numpy()] = 1
            size = m.sum(1, dtype=np.int64)
            rows = np.flatnonzero(size)
            yield i + rows, m[rows], size[rows]

    def product(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
        n = (x.astype(np.float32) @ y.astype(np.float32).T).astype(np.float64)
        return np.where(n > 0, n / (nx[:, None] + ny - n), -1.0)

    return _dense(a, b, p.field, units, product, float(p.min), max(s.rows, d.rows), None, block, np.uint8)


def _dense(a: DataFrame, b: DataFrame, field: str, units, product, least: float, classes: int, cap: int | None, most: int = 2048, kind=np.float64) -> DataFrame:
    """a, b, score of the classes whose product is at least so much, block by block. units: (rows, matrix, sizes) of the column x of a batch."""
    spark = a.sparkSession
    n = _parts(spark)
    across = min(4, n) if cap else max(1, math.isqrt(n))
    down = -(-n // across)
    rows = max(8, min(most, classes // (4 * max(across, down))))  # few classes can be many pairs of nodes: all cells get some

    def blocks(df: DataFrame, name: str) -> DataFrame:
        keep = df.schema[name].dataType
        out = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("c", T.ArrayType(keep)), T.StructField("u", T.BinaryType()), T.StructField("size", T.BinaryType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                whole = b.column("c")
                for at, m, size in units(b):
                    for i in range(0, len(at), rows):
                        c = whole.take(pa.array(at[i : i + rows]))
                        yield pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c), pa.array([m[i : i + rows].astype(kind).tobytes()], pa.binary()), pa.array([size[i : i + rows].astype(np.float64).tobytes()], pa.binary())], ["dim", "c", "u", "size"])

        made = df.select(F.col(name).alias("c"), F.col(name)[field].alias("x")).mapInArrow(run, out)
        mine, other, count, others = ("i", "j", down, across) if name == "a" else ("j", "i", across, down)
        made = made.select("dim", F.col("c").alias(f"{name}c"), F.col("u").alias(f"{name}u"), F.col("size").alias(f"{name}n"), F.pmod(F.xxhash64(F.col("c")[0]["m"][0]), F.lit(count)).cast("int").alias(mine))
        return made.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    out = T.StructType([T.StructField("a", a.schema["a"].dataType), T.StructField("b", b.schema["b"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        longest = lambda c: pc.max(pc.list_value_length(c.field("m"))).as_py() or 1
        for t in batches:
            for r in range(t.num_rows):
                dim = t.column("dim")[r].as_py()
                ac, bc = t.column("ac")[r].values, t.column("bc")[r].values
                x, y = (np.frombuffer(t.column(c)[r].as_buffer(), kind).reshape(-1, dim) for c in ("au", "bu"))
                nx, ny = (np.frombuffer(t.column(c)[r].as_buffer(), np.float64) for c in ("an", "bn"))
                score = product(x, y, nx, ny)
                i, j = np.nonzero(score >= least)
                if cap is None:
                    step = 1 + 200_000 // (longest(ac) + longest(bc))
                    for k in range(0, len(i), step):
                        u, v = i[k : k + step], j[k : k + step]
                        yield pa.RecordBatch.from_arrays([ac.take(pa.array(u)), bc.take(pa.array(v)), pa.array(score[u, v].astype(float))], ["a", "b", "score"])
                    continue
                name = (dim, ac[0]["m"][0].as_py())
                if name not in kept:
                    kept[name] = [ac, np.full((len(x), cap + 1), -np.inf), [], 0]
                state = kept[name]
                top = np.where(score >= least, score, -np.inf)
                if top.shape[1] > cap + 1:
                    top = np.partition(top, top.shape[1] - cap - 1, axis=1)[:, -cap - 1 :]
                state[1] = np.sort(np.concatenate([state[1], top], axis=1), axis=1)[:, -cap - 1 :]
                ok = score[i, j] >= state[1][i, 0]
                state[2].append((i[ok], score[i, j][ok], bc.take(pa.array(j[ok]))))
                state[3] += int(ok.sum())
                if state[3] > 4 * (cap + 1) * len(x):
                    state[2], state[3] = _prune(state)
        for state in kept.values():
            for i, score, c in _prune(state)[0]:
                step = 1 + 200_000 // (longest(state[0]) + longest(c))
                for k in range(0, len(i), step):
                    yield pa.RecordBatch.from_arrays([state[0].take(pa.array(i[k : k + step])), c[k : k + step], pa.array(score[k : k + step].astype(float))], ["a", "b", "score"])

    met = blocks(a, "a").join(blocks(b, "b"), ["dim", "i", "j"])
    return met.select("dim", "ac", "au", "an", "bc", "bu", "bn").mapInArrow(run, out)


def _prune(state: list) -> tuple[list, int]:
    """What still can be among the best of its row."""
    out = []
    for i, score, c in state[2]:
        ok = score >= state[1][i, 0]
        if ok.any():
            out.append((i[ok], score[ok], c.filter(pa.array(ok))))
    return out, sum(len(i) for i, _, _ in out)


#: Distinct tokens up to which sets are compared as bits; more are compared as arrays.
FEW_TOKENS, WORD = 1024, 62


def _overlap_bits(least: float, tokens: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Overlap over few tokens (k, side, t): a set is a few integers, which its prefix rows carry along; a pair is taken where it meets first, so that none comes twice.

    Tokens are numbered from the rarest on, so the first one that two sets share is the lowest bit of both.
    """
    spark = tokens.sparkSession
    counts = sorted((r["n"], r["t"]) for r in tokens.groupBy("t").agg(F.count("*").alias("n")).collect())  # FEW_TOKENS at most
    words = max(1, -(-len(counts) // WORD))
    full = (1 << WORD) - 1
    rows = [(t, i, *(full if w < i // WORD else (1 << i % WORD) - 1 if w == i // WORD else 0 for w in range(words)), *(1 << i % WORD if w == i // WORD else 0 for w in range(words))) for i, (_, t) in enumerate(counts)]
    kind = tokens.schema["t"].dataType
    fields = [T.StructField("t", kind), T.StructField("c", T.IntegerType())] + [T.StructField(f"{x}{w}", T.LongType()) for x in "mb" for w in range(words)]
    codes = F.broadcast(spark.createDataFrame(rows, T.StructType(fields)))
    coded = tokens.join(codes, "t")
    sets = coded.groupBy("side", "k").agg(F.sort_array(F.collect_list(F.struct("c", *[f"m{w}" for w in range(words)]))).alias("cs"), *[F.bit_or(f"b{w}").alias(f"b{w}") for w in range(words)])
    size = F.size("cs")
    longest = F.least(size, size - F.ceil(F.lit(float(least)) * size - 1e-9).cast("int") + 1)
    prefix = sets.select("side", "k", size.alias("n"), *[f"b{w}" for w in range(words)], F.explode(F.slice("cs", F.lit(1), longest)).alias("x"))
    classes = {"s": a.select(F.col("a.m")[0].alias("s"), "a"), "d": b.select(F.col("b.m")[0].alias("d"), "b")}
    # few tokens are few keys: each is cut into parts, so that all tasks have some
    parts = 1 + 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(counts))
    sides = []
    for side, part in (("s", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int")), ("d", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))):
        masks = [F.col(f"x.m{w}").alias(f"m{w}") for w in range(words)] if side == "s" else []
        one = prefix.where(F.col("side") == side).select(F.col("k").alias(side), F.col("n").alias(f"{side}n"), F.col("x.c").alias("c"), *masks, *[F.col(f"b{w}").alias(f"{side}{w}") for w in range(words)], part.alias("part"))
        sides.append(one.join(classes[side], side))
    both = [F.col(f"s{w}").bitwiseAND(F.col(f"d{w}")) for w in range(words)]
    first, shared = F.lit(True), F.lit(0)
    for w, x in enumerate(both):
        first = first & (x.bitwiseAND(F.col(f"m{w}")) == 0)
        shared = shared + F.bit_count(x)
    near = (F.col("sn") >= F.lit(least) * F.col("dn") - 1e-9) & (F.col("dn") >= F.lit(least) * F.col("sn") - 1e-9)
    met = sides[0].hint("shuffle_hash").join(sides[1].hint("shuffle_hash"), ["c", "part"]).where(near & first)
    return met.select("a", "b", (shared / (F.col("sn") + F.col("dn") - shared)).alias("score")).where(F.col("score") >= least)


#: Share of the pairs right at the least cosine that the tables are to find, and tables at most.
RECALL, TABLES = 0.95, 192
#: What a pair that shares a table costs, as pairs of a matrix product: it is shuffled, made distinct and joined with both vectors.
HASHED_COST = 1000


def hashing(least: float) -> tuple[int, int] | None:
    """Tables and sign bits a table, so that a pair at the least cosine shares a table with a chance of RECALL; None where that would cost more than all pairs once in blocks."""
    same = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    for bits in range(24, 0, -1):
        hit = same**bits
        tables = 1 if hit >= RECALL else math.ceil(math.log(1 - RECALL) / math.log1p(-hit)) if hit > 0 else TABLES + 1
        if tables <= TABLES:
            return (tables, bits) if tables * HASHED_COST < 1 << bits else None
    return None


def _vector_hashed(p: VectorSimilar, s: DataFrame, d: DataFrame, tables: int, bits: int, seed: int = 9) -> DataFrame:
    least = float(p.min)

    def signs(df: DataFrame, n: str) -> DataFrame:
        """The key, its unit vector as bytes and its codes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes: dict[int, np.ndarray] = {}
            for b in batches:
                for rows, m in _units(b):
                    dim = m.shape[1]
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([seed, dim]).normal(size=(tables * bits, dim))
                    on = (m @ planes[dim].T > 0).reshape(len(m), tables, bits)
                    codes = (on << np.arange(bits)).sum(2) + (np.arange(tables) << 24) + (dim << 32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * tables, pa.int32()), pa.array(codes.ravel().astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(rows)), pa.array([x.tobytes() for x in m], pa.binary()), lists], [n, f"{n}u", "h"])

        return df.select(F.col(n).alias("k"), "x").mapInArrow(run, f"{n} string, {n}u binary, h array<bigint>")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            su, du = b.column("su").to_pylist(), b.column("du").to_pylist()
            value = np.array([np.frombuffer(x) @ np.frombuffer(y) for x, y in zip(su, du, strict=True)], float)
            out = pa.RecordBatch.from_arrays([b.column("s"), b.column("d"), pa.array(np.minimum(value, 1.0))], ["s", "d", "score"])
            yield out.filter(pa.array(value >= least))

    a, b = signs(s, "s"), signs(d, "d")
    met = a.select("s", F.explode("h").alias("h")).join(b.select("d", F.explode("h").alias("h")), "h").select("s", "d").distinct()
    return met.join(a.select("s", "su"), "s").join(b.select("d", "du"), "d").select("s", "d", "su", "du").mapInArrow(score, "s string, d string, score double")


def pairs(p: Predicate, src: DataFrame, dst: DataFrame, approximate: bool = False, but: tuple = (), digits: int | None = None, keep=None, also: tuple = ()) -> DataFrame:
    """s, d and score of all pairs for which the predicate holds; a pair once.

    but: predicates (plain) that must not hold; keep: a test of two structs of fields and the score, which reads the fields of also too; digits: the score is rounded.
    """
    if _by_class(p):
        s, d = _two(src, dst, _fields(p, *but, *also))
        met = _meet(p, s, d, approximate)
        for x in but:
            met = met.where(score_of(x, s.schema, d.schema, F.col("a"), F.col("b")).isNull())
        if keep is not None:
            met = met.where(keep(s.schema, d.schema, F.col("a"), F.col("b"), F.col("score")))
        return _spread(met if digits is None else met.withColumn("score", F.round("score", digits)))
    if but or keep is not None:
        raise RuleError("only plain predicates are tested where pairs meet")
    out = None
    if isinstance(p, All):
        for x in p.parts:
            one = pairs(x, src, dst, approximate)
            out = one if out is None else out.join(one.withColumnRenamed("score", "other"), ["s", "d"]).select("s", "d", F.least("score", "other").alias("score"))
    elif isinstance(p, Any):
        for x in p.parts:
            one = pairs(x, src, dst, approximate)
            out = one if out is None else out.unionByName(one)
        out = out.groupBy("s", "d").agg(F.max("score").alias("score"))
    else:
        out = key_match(p, src, dst)
    return out if digits is None else out.withColumn("score", F.round("score", digits))


def vector_similar(p: VectorSimilar, src: DataFrame, dst: DataFrame, approximate: bool = False) -> DataFrame:
    return pairs(p, src, dst, approximate)


def _fields(*ps: Predicate) -> list[str]:
    return list(dict.fromkeys(x.field for p in ps for x in leaves(p)))


def direct(p: Predicate, src: DataFrame, dst: DataFrame, approximate: bool = False, cap: int | None = None, but: tuple = (), digits: int | None = None) -> DataFrame:
    """s, d and score of different nodes; cap: the best so many of each source, ties by key."""
    if cap is None:
        return pairs(p, src, dst, approximate, but, digits).where("s != d")
    if _by_class(p):
        s, d = _two(src, dst, _fields(p))
        near = isinstance(p, NumericWithin) and _fits(p, s.schema, d.schema)
        found = _best(_nearest(p, s, d, cap) if near else _meet(p, s, d, approximate, cap), cap)
    else:
        best = W.partitionBy("s").orderBy(F.col("score").desc(), F.col("d"))
        found = pairs(p, src, dst, approximate).where("s != d").withColumn("n", F.row_number().over(best)).where(F.col("n") <= cap).drop("n")
    return found if digits is None else found.withColumn("score", F.round("score", digits))


# ---- rules -------------------------------------------------------------------------------------------


def _nodes(g: PropertyGraph, label: str, namespace: str | None) -> DataFrame:
    df = g.nodes.get(label)
    if df is None:
        return g.spark.createDataFrame([], "key string")
    return df.where(F.col("ns") == namespace) if namespace is not None and "ns" in df.columns else df


def fire(g: PropertyGraph, rule: RuleDef, digits: int | None = None, but: tuple = (), only: Only | None = None) -> DataFrame:
    """src, dst and score of the edges that the rule derives on the graph as it is.

    digits: the score is rounded; but: predicates whose pairs are left out; only: see Only.
    """
    rule.validate()
    dst = _nodes(g, rule.dst_label, rule.namespace)
    names = [F.col("s").alias("src"), F.col("d").alias("dst"), "score"]
    if rule.via_edge:
        via = _nodes(g, rule.via_label, rule.namespace)
        e = g.edges.get(rule.via_edge)
        if e is None:
            return _none(dst).select(*names)
        a, b = ("src", "dst") if rule.via_dir == "out" else ("dst", "src")
        hop = e.df.select(F.col(a).alias("from"), F.col(b).alias("s"))
        hop = hop.join(_nodes(g, rule.src_label, rule.namespace).select(F.col("key").alias("from")), "from", "left_semi")
        found = _via(pairs(rule.predicate, via, dst, rule.approximate), hop)
        if rule.max_edges is not None:
            best = W.partitionBy("s").orderBy(F.col("score").desc(), F.col("d"))
            found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= rule.max_edges)
        found = found if digits is None else found.withColumn("score", F.round("score", digits))
        return (found if only is None else found.where(only.test())).select(*names)
    src = _nodes(g, rule.src_label, rule.namespace)
    make = lambda x, y: direct(rule.predicate, x, y, rule.approximate, rule.max_edges, but, digits)
    if only is None:
        return make(src, dst).select(*names)
    if only.sources is not None:
        return make(src.join(only.sources, "key", "left_semi"), dst).select(*names)
    a, b = F.col("key") == only.a, F.col("key") == only.b
    if only.b is not None:
        return make(src.where(a), dst.where(b) if rule.max_edges is None else dst).where(only.test()).select(*names)
    return make(src.where(a), dst).unionByName(make(src.where(~a), dst.where(a))).select(*names)


@dataclass(frozen=True)
class Only:
    """Edges that are asked for: from a to b; at a, if no rule is capped; or of some sources (key)."""

    a: str | None = None
    b: str | None = None
    sources: DataFrame | None = None

    def test(self) -> Column:
        return (F.col("s") == self.a) & (F.col("d") == self.b)


def _via(found: DataFrame, hop: DataFrame) -> DataFrame:
    """s, d, score of the sources of a hop (from, s): sources that reach the same nodes are computed once."""
    reach = _classes(hop.groupBy(F.col("from").alias("key")).agg(F.sort_array(F.collect_set("s")).alias("vs")), ["vs"]).df
    each = reach.select(F.col("x.m")[0].alias("id"), F.explode("x.vs").alias("s")).join(found, "s").groupBy("id", "d").agg(F.max("score").alias("score"))
    each = each.join(reach.select(F.col("x.m")[0].alias("id"), F.col("x.m").alias("m")), "id").select("m", "d", "score").repartition(4 * _parts(found.sparkSession))
    return each.select(F.explode("m").alias("s"), "d", "score").where("s != d")


def order(rules: list[RuleDef]) -> list[RuleDef]:
    """As declared, but a via rule after the rules that derive its edge."""
    left, out = list(rules), []
    while left:
        ready = [r for r in left if not r.via_edge or r.via_edge not in {x.edge_type for x in left if x is not r}] or left[:1]
        out.append(ready[0])
        left.remove(ready[0])
    return out


def derive(g: PropertyGraph, rules: list[RuleDef], only: Only | None = None) -> PropertyGraph:
    """The graph with the edges of all rules. Who writes an edge first owns it: edges that are there, then rules in order.

    Rules that feed each other are fired CHAIN_MOST times at most. only: of edges that feed no rule, these are enough.
    """
    base = {r.edge_type: g.edges.get(r.edge_type) for r in rules}
    names = [r.name for r in rules]
    if len(set(names)) < len(names):
        raise RuleError("rules have different names")
    feeds = {r.name for r in rules if r.via_edge and any(x.edge_type == r.via_edge for x in rules)}
    cyclic = any(r.name in feeds and r.via_edge == r.edge_type for r in rules) or _cycle(rules)
    for _ in range(CHAIN_MOST if cyclic else 1):
        made: dict[str, DataFrame] = {}
        owners: dict[str, list[RuleDef]] = {}
        now = g
        for r in order(rules):
            before = owners.setdefault(r.edge_type, [])
            tested = bool(before) and _testable(r, before)  # earlier owners are tested where the pairs meet
            found = fire(now, r, but=tuple(x.predicate for x in before) if tested else (), only=None if r.edge_type in {x.via_edge for x in rules} else only)
            found = found.select("src", "dst", "score", F.lit(r.name).alias("rule"))
            before.append(r)
            manual = base[r.edge_type]
            if manual is not None and not manual.derived:
                found = found.join(manual.df.select("src", "dst"), ["src", "dst"], "left_anti")
            if r.edge_type in made:
                found = made[r.edge_type].unionByName(found if tested else found.join(made[r.edge_type].select("src", "dst"), ["src", "dst"], "left_anti"))
            made[r.edge_type] = found
            now = _with(now, r, made[r.edge_type], base[r.edge_type], rules)
        g = now
    return g


def _testable(r: RuleDef, before: list[RuleDef]) -> bool:
    """Whether the pairs of earlier rules can be told from the fields of the two nodes."""
    same = lambda x: (x.src_label, x.dst_label, x.namespace) == (r.src_label, r.dst_label, r.namespace)
    return _by_class(r.predicate) and all(same(x) and plain(x.predicate) and x.max_edges is None and not x.via_edge for x in before) and r.max_edges is None and not r.via_edge


def _cycle(rules: list[RuleDef]) -> bool:
    after = {r.name: [x.name for x in rules if x.via_edge == r.edge_type] for r in rules}

    def reaches(a: str, b: str, seen: set) -> bool:
        return any(x == b or x not in seen and reaches(x, b, seen | {x}) for x in after[a])

    return any(reaches(n, n, set()) for n in after)


def _with(g: PropertyGraph, r: RuleDef, found: DataFrame, manual, rules: list[RuleDef]) -> PropertyGraph:
    weights = sorted({x.weight_prop for x in rules if x.edge_type == r.edge_type and x.weight_prop})
    df = found.select("src", "dst", *[F.col("score").alias(w) for w in weights], "score", "rule") if "score" not in weights else found
    if manual is not None and not manual.derived:
        df = manual.df.unionByName(df, allowMissingColumns=True)
    same = [x for x in rules if x.edge_type == r.edge_type]
    one = len({(x.src_label, x.dst_label) for x in same}) == 1 and manual is None
    return g.with_edges(r.edge_type, df, r.src_label if one else None, r.dst_label if one else None, closed=one, unique=True, derived=manual is None, rule=r.name)


# ---- around rules --------------------------------------------------------------------------------------


def evidence(p: Predicate, a: Column, b: Column) -> Column:
    """Text of why two nodes match; a and b are structs of their properties."""
    if isinstance(p, (All, Any)):
        return F.concat_ws("; ", *[evidence(x, a, b) for x in p.parts])
    x = a[p.field]
    if isinstance(p, KeyMatch):
        return F.concat(F.lit(f"{p.field} = "), b["key"])
    y = b[p.field]
    if isinstance(p, FieldEqual):
        return F.concat(F.lit(f"{p.field} = "), x.cast("string"))
    if isinstance(p, Overlap):
        return F.concat(F.lit(f"{p.field} shares "), F.array_join(F.array_sort(F.array_intersect(x, y)), ", "))
    if isinstance(p, NumericWithin):
        return F.concat(F.lit(f"{p.field} differs by "), F.abs(x - y).cast("string"))
    if isinstance(p, GeoRadius):
        return F.concat(F.lit(f"{p.field} km "), F.round(haversine(x[0], x[1], y[0], y[1]), 3).cast("string"))
    return F.concat(F.lit(f"{p.field} cosine "), F.round(cosine(x, y), 6).cast("string"))


def explain(g: PropertyGraph, rules: list[RuleDef], a: str, b: str) -> DataFrame:
    """rule, edge_type, weight, predicate and evidence of the derived edges from a to b."""
    out = None
    derived = derive(g, rules, Only(a, b))
    for r in rules:
        e = derived.edges[r.edge_type].df
        if "rule" not in e.columns:
            continue
        e = e.where((F.col("src") == a) & (F.col("dst") == b) & (F.col("rule") == r.name))
        text = F.lit(None).cast("string")
        if not r.via_edge:
            s, d = g.nodes[r.src_label], g.nodes[r.dst_label]
            e = e.join(s.where(F.col("key") == a).select(F.struct("*").alias("a")), F.lit(True)).join(d.where(F.col("key") == b).select(F.struct("*").alias("b")), F.lit(True))
            text = evidence(r.predicate, F.col("a"), F.col("b"))
        one = e.select(F.col("rule"), F.lit(r.edge_type).alias("edge_type"), F.col("score").alias("weight"), F.lit(type(r.predicate).__name__).alias("predicate"), text.alias("evidence"))
        out = one if out is None else out.unionByName(one)
    return out


def what_if(g: PropertyGraph, rules: list[RuleDef], label: str, key: str, field: str, value) -> DataFrame:
    """change (lost or gained), rule, edge_type, src, dst if the property had that value. Nothing is written."""
    df = g.nodes[label]
    t = df.schema[field].dataType if field in df.columns else None
    new = F.lit(value).cast(t) if t is not None else F.lit(value)
    old = F.col(f"`{field}`") if t is not None else F.lit(None)
    other = replace(g, nodes=g.nodes | {label: df.withColumn(field, F.when(F.col("key") == key, new).otherwise(old))})
    only = None
    if not any(r.via_edge for r in rules):  # only edges at the node can change, or of sources that are linked to it
        only = Only(key)
        if any(r.max_edges for r in rules):
            near = [g.nodes[label].where(F.col("key") == key).select("key")]
            for x in (g, other):
                for r in rules:
                    at = _nodes(x, r.dst_label, r.namespace).where(F.col("key") == key)
                    near.append(pairs(r.predicate, _nodes(x, r.src_label, r.namespace), at, r.approximate).select(F.col("s").alias("key")))
            only = Only(sources=reduce(DataFrame.unionByName, near).distinct())
    sides = []
    for x in (g, other):
        made, union = derive(x, rules, only), None
        for etype in dict.fromkeys(r.edge_type for r in rules):
            e = made.edges[etype].df.where("rule is not null").select("rule", F.lit(etype).alias("edge_type"), "src", "dst")
            union = e if union is None else union.unionByName(e)
        sides.append(union)
    lost = sides[0].exceptAll(sides[1]).select(F.lit("lost").alias("change"), "*")
    return lost.unionByName(sides[1].exceptAll(sides[0]).select(F.lit("gained").alias("change"), "*"))


def rebuild(g: PropertyGraph, rules: list[RuleDef], name: str) -> DataFrame:
    """The edges that one rule owns, derived afresh."""
    r = next(x for x in rules if x.name == name)
    return derive(g, rules).edges[r.edge_type].df.where(F.col("rule") == name)


def refire(g: PropertyGraph, rule: RuleDef, before: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges of a direct rule after some nodes changed, from the edges before: only sources that may be touched are derived again.

    changed: key of changed, new or deleted nodes. The result equals that of firing the rule on the whole graph.
    """
    keys = changed.select("key").distinct()
    src, dst = _nodes(g, rule.src_label, rule.namespace), _nodes(g, rule.dst_label, rule.namespace)
    if rule.max_edges is None and not rule.via_edge:  # an edge depends on its two ends only
        kept = before.join(F.broadcast(keys.select(F.col("key").alias("src"))), "src", "left_anti").join(F.broadcast(keys.select(F.col("key").alias("dst"))), "dst", "left_anti")
        fresh = direct(rule.predicate, src.join(keys, "key", "left_semi"), dst, rule.approximate).unionByName(direct(rule.predicate, src.join(keys, "key", "left_anti"), dst.join(keys, "key", "left_semi"), rule.approximate))
        return kept.select("src", "dst", "score").unionByName(fresh.select(F.col("s").alias("src"), F.col("d").alias("dst"), "score"))
    # a source is touched if it changed, was linked to what changed, or matches it now
    by_target = pairs(rule.predicate, src, dst.join(keys, "key", "left_semi"), rule.approximate).select(F.col("s").alias("key"))
    linked = before.join(keys.select(F.col("key").alias("dst")), "dst", "left_semi").select(F.col("src").alias("key"))
    touched = keys.unionByName(by_target).unionByName(linked).distinct()
    fresh = direct(rule.predicate, src.join(touched, "key", "left_semi"), dst, rule.approximate, rule.max_edges).select(F.col("s").alias("src"), F.col("d").alias("dst"), "score")
    kept = before.join(touched.select(F.col("key").alias("src")), "src", "left_anti").select("src", "dst", "score")
    return kept.unionByName(fresh)


def auto_fk(g: PropertyGraph, label: str) -> list[RuleDef]:
    """A KeyMatch rule for each text field <stem>_id of the label whose values are keys of another label."""
    out = []
    df = g.nodes[label]
    for f in df.schema.fields:
        plain = isinstance(f.dataType, T.StringType)
        if not f.name.endswith("_id") or not plain and not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType)):
            continue
        values = df.select((F.col(f.name) if plain else F.explode(f.name)).alias("v")).where("v is not null").distinct()
        hits = values.join(g.all_nodes().where(F.col("label") != label), F.col("v") == F.col("key")).groupBy("label").count().orderBy(F.col("count").desc(), "label").first()
        if hits:
            out.append(RuleDef(f"auto_fk_{label}_{f.name}", label, hits["label"], KeyMatch(f.name), f.name[:-3].upper()))
    return out


def suggest(g: PropertyGraph) -> list[dict]:
    """Rules that the data suggest: key matches, shared scalars, overlapping lists, close numbers, similar vectors; with estimated edges."""
    out: list[dict] = []
    for label, df in sorted(g.nodes.items()):
        n = df.count()
        if not n:
            continue
        for f in df.schema.fields:
            t, c = f.dataType, F.col(f"`{f.name}`")
            if f.name == "key":
                continue
            if f.name.endswith("_id") and isinstance(t, T.StringType):
                out += [{"rule": r, "detector": "key", "est_edges": n} for r in auto_fk(replace(g, nodes=g.nodes | {label: df.select("key", f.name)}), label)]
            elif isinstance(t, T.StringType):
                k, full = df.agg(F.approx_count_distinct(c), F.count(c)).first()
                if 1 < k <= full / 4:
                    out.append({"rule": RuleDef(f"same_{label}_{f.name}", label, label, FieldEqual(f.name), f"SAME_{f.name.upper()}"), "detector": "equal", "est_edges": int(full * (full / k - 1))})
            elif isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType):
                out.append({"rule": RuleDef(f"overlap_{label}_{f.name}", label, label, Overlap(f.name, 0.5), f"SHARES_{f.name.upper()}"), "detector": "overlap", "est_edges": n})
            elif _is_numbers(t):
                sizes = df.agg(F.min(F.size(c)), F.max(F.size(c))).first()
                if sizes[0] == sizes[1] and sizes[0] and sizes[0] > 2:
                    out.append({"rule": RuleDef(f"similar_{label}_{f.name}", label, label, VectorSimilar(f.name, 0.85), f"SIMILAR_{f.name.upper()}", max_edges=32), "detector": "vector", "est_edges": n})
                elif sizes[0] == sizes[1] == 2:
                    out.append({"rule": RuleDef(f"near_{label}_{f.name}", label, label, GeoRadius(f.name, 50.0), f"NEAR_{f.name.upper()}"), "detector": "geo", "est_edges": n})
            elif isinstance(t, T.NumericType):
                low, high = df.select(F.percentile(c, 0.25), F.percentile(c, 0.75)).first()
                if low is not None and high > low:
                    out.append({"rule": RuleDef(f"close_{label}_{f.name}", label, label, NumericWithin(f.name, float(high - low) / 20), f"CLOSE_{f.name.upper()}", max_edges=32), "detector": "numeric", "est_edges": n})
    return sorted(out, key=lambda x: (-x["est_edges"], x["rule"].name))
