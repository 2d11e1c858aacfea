"""Typed columns: a Spark column with what the compiler knows of it, and the value semantics of the language.

Comparison is three-valued; across types `=` is false and `<` is null; null is the largest value of
an order; integers saturate in + - *; lists compare element by element with nulls unknown.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_MAX, LONG_MIN = 2**63 - 1, -(2**63)
DURATION = T.StructType([T.StructField("months", T.LongType()), T.StructField("days", T.LongType()), T.StructField("nanos", T.LongType())])
DATETIME = T.StructType([T.StructField("instant", T.TimestampType()), T.StructField("offset_s", T.IntegerType())])


@dataclass
class V:
    """A value: its column, its type; kind is value, node, rel, rels (a variable-length relationship) or path."""

    col: Column
    type: T.DataType = field(default_factory=T.NullType)
    kind: str = "value"
    props: dict[str, T.DataType] = field(default_factory=dict)
    labels: tuple[str, ...] | None = None
    const: Any = None  # the value of a literal, where it is one
    is_const: bool = False


def lit(value: Any) -> V:
    if isinstance(value, V):
        return value
    if value is None:
        return V(F.lit(None), T.NullType(), const=None, is_const=True)
    if isinstance(value, bool):
        return V(F.lit(value), T.BooleanType(), const=value, is_const=True)
    if isinstance(value, int):
        return V(F.lit(value).cast("bigint"), T.LongType(), const=value, is_const=True)
    if isinstance(value, float):
        return V(F.lit(value), T.DoubleType(), const=value, is_const=True)
    if isinstance(value, str):
        return V(F.lit(value), T.StringType(), const=value, is_const=True)
    if isinstance(value, (list, tuple)):
        out = list_of([lit(x) for x in value])
        return V(out.col, out.type, const=list(value), is_const=True)
    if isinstance(value, dict):
        items = {k: lit(v) for k, v in sorted(value.items())}
        out = map_of(items)
        return V(out.col, out.type, const=value, is_const=True)
    import datetime as dt

    if isinstance(value, dt.datetime):
        return V(F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz"), T.TimestampNTZType())
    if isinstance(value, dt.date):
        return V(F.lit(value.isoformat()).cast("date"), T.DateType())
    raise TypeError(f"no value of the language: {value!r}")


class _Null(V):
    """The null literal; its column is made when it is used, as that needs a session."""

    def __init__(self) -> None:
        self.type, self.kind, self.props, self.labels, self.const, self.is_const = T.NullType(), "value", {}, None, None, True

    @property
    def col(self) -> Column:
        return F.lit(None)


NULL = _Null()


def is_int(t) -> bool:
    return isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


def is_float(t) -> bool:
    return isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType))


def is_num(t) -> bool:
    return is_int(t) or is_float(t)


def is_str(t) -> bool:
    return isinstance(t, T.StringType)


def is_bool(t) -> bool:
    return isinstance(t, T.BooleanType)


def is_list(t) -> bool:
    return isinstance(t, T.ArrayType)


def is_null(t) -> bool:
    return isinstance(t, T.NullType)


def is_duration(t) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == DURATION.fieldNames()


def is_datetime(t) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == DATETIME.fieldNames()


def is_map(t) -> bool:
    return isinstance(t, T.MapType) or isinstance(t, T.StructType) and not is_duration(t) and not is_datetime(t)


def family(t) -> str:
    for name, test in (("null", is_null), ("number", is_num), ("string", is_str), ("boolean", is_bool), ("list", is_list), ("duration", is_duration), ("datetime", is_datetime), ("map", is_map)):
        if test(t):
            return name
    if isinstance(t, T.DateType):
        return "date"
    return "localdatetime" if isinstance(t, T.TimestampNTZType) else "localdatetime" if isinstance(t, T.TimestampType) else "binary" if isinstance(t, T.BinaryType) else t.simpleString()


def normal(t: T.DataType) -> T.DataType:
    """The type that a stored column is read as: 64-bit integers and floats, local date-times."""
    if is_int(t):
        return T.LongType()
    if is_float(t):
        return T.DoubleType()
    if isinstance(t, T.TimestampType):
        return T.TimestampNTZType()
    if isinstance(t, T.ArrayType):
        return T.ArrayType(normal(t.elementType))
    return t


def common(types: list) -> T.DataType:
    """One type for all, or string where they differ."""
    real = [t for t in types if not is_null(t)]
    if not real:
        return T.NullType()
    if all(is_int(t) for t in real):
        return T.LongType()
    if all(is_num(t) for t in real):
        return T.DoubleType()
    if all(is_list(t) for t in real):
        return T.ArrayType(common([t.elementType for t in real]))
    first = real[0]
    if all(t.simpleString() == first.simpleString() for t in real):
        return first
    if {family(t) for t in real} == {"date", "localdatetime"}:
        return T.TimestampNTZType()
    return T.StringType()


def let(col: Column, f) -> Column:
    """f of a column that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(col), f), 0)


def as_type(v: V, t: T.DataType) -> Column:
    if v.type.simpleString() == t.simpleString() or is_null(t):
        return v.col
    if is_str(t) and not is_null(v.type) and not is_str(v.type):
        return to_text(v).col
    return v.col.cast(t)


def list_of(items: list[V]) -> V:
    t = common([x.type for x in items])
    if not items:
        return V(F.array().cast("array<string>"), T.ArrayType(T.NullType()))
    if any(x.kind == "node" for x in items):
        items = [V(x.col["key"], T.StringType()) if x.kind == "node" else x for x in items]
        t = T.StringType()
    return V(F.array(*[as_type(x, t) for x in items]), T.ArrayType(t))


def map_of(items: dict[str, V]) -> V:
    names = sorted(items)
    cols = [entity(items[k]) for k in names]
    return V(F.struct(*[c.col.alias(k) for k, c in zip(names, cols, strict=True)]) if names else F.create_map().cast("map<string,string>"), T.StructType([T.StructField(k, c.type) for k, c in zip(names, cols, strict=True)]) if names else T.MapType(T.StringType(), T.StringType()))


def entity(v: V) -> V:
    """What a variable gives as a plain value: a node its key, a relationship its ends."""
    if v.kind == "node":
        return V(v.col["key"], T.StringType())
    if v.kind == "rel":
        return V(F.when(v.col.isNotNull(), F.struct(v.col["etype"].alias("type"), v.col["src"].alias("start"), v.col["dst"].alias("end"))), REL)
    if v.kind == "rels":
        return V(v.col, T.ArrayType(REL))
    return v


REL = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.StringType()), T.StructField("end", T.StringType())])
PATH = T.StructType([T.StructField("nodes", T.ArrayType(T.StringType())), T.StructField("relationships", T.ArrayType(REL)), T.StructField("length", T.LongType())])


# ---- comparison ----------------------------------------------------------------------------------


def _either_null(a: V, b: V, value: Column) -> Column:
    return F.when(a.col.isNull() | b.col.isNull(), F.lit(None).cast("boolean")).otherwise(value)


def equal(a: V, b: V) -> V:
    a, b = entity(a), entity(b)
    if is_null(a.type) or is_null(b.type):
        return V(F.lit(None).cast("boolean"), T.BooleanType())
    fa, fb = family(a.type), family(b.type)
    if fa != fb:
        return V(_either_null(a, b, F.lit(False)), T.BooleanType())
    if fa == "list":
        ea, eb = a.type.elementType, b.type.elementType
        if is_null(ea) or is_null(eb):
            every = F.lit(True)
        else:
            every = F.forall(F.zip_with(a.col, b.col, lambda x, y: equal(V(x, ea), V(y, eb)).col), lambda r: r)
        return V(F.when(F.size(a.col) != F.size(b.col), F.lit(False)).otherwise(every), T.BooleanType())
    if fa == "datetime":
        return V(a.col["instant"] == b.col["instant"], T.BooleanType())
    if fa == "map" and isinstance(a.type, T.StructType) and isinstance(b.type, T.StructType):
        if a.type.fieldNames() != b.type.fieldNames():
            return V(_either_null(a, b, F.lit(False)), T.BooleanType())
        out = F.lit(True)
        for f, g in zip(a.type.fields, b.type.fields, strict=True):
            out = out & equal(V(a.col[f.name], f.dataType), V(b.col[g.name], g.dataType)).col
        return V(out, T.BooleanType())
    return V(a.col == b.col, T.BooleanType())


def compare(op: str, a: V, b: V) -> V:
    a, b = entity(a), entity(b)
    if op == "=":
        return equal(a, b)
    if op == "<>":
        return V(~equal(a, b).col, T.BooleanType())
    fa, fb = family(a.type), family(b.type)
    if fa != fb or fa in ("list", "map", "duration", "null"):
        return V(F.lit(None).cast("boolean"), T.BooleanType())
    x, y = (a.col["instant"], b.col["instant"]) if fa == "datetime" else (a.col, b.col)
    return V({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], T.BooleanType())


def member(a: V, b: V) -> V:
    """x IN list, whole elements, with unknown for nulls."""
    a = entity(a)
    if is_null(b.type):
        return V(F.lit(None).cast("boolean"), T.BooleanType())
    element = b.type.elementType
    if b.is_const and isinstance(b.const, list) and not is_null(a.type) and all(x is not None and not isinstance(x, (list, dict)) for x in b.const):
        fits = [x for x in b.const if family(lit(x).type) == family(a.type)]
        if fits:
            return V(a.col.isin(*fits), T.BooleanType())
        return V(F.when(a.col.isNull() & F.lit(bool(b.const)), F.lit(None)).otherwise(F.lit(False)), T.BooleanType())
    if is_null(element):
        return V(F.when(F.size(b.col) == 0, F.lit(False)), T.BooleanType())
    return V(F.when(F.size(b.col) == 0, F.lit(False)).otherwise(F.exists(b.col, lambda x: equal(a, V(x, element)).col)), T.BooleanType())


def truth(v: V) -> Column:
    """A value as a condition: zero, empty text and the empty list are false."""
    v = entity(v)
    if is_bool(v.type):
        return v.col
    if is_num(v.type):
        return v.col != 0
    if is_str(v.type):
        return v.col != ""
    if is_list(v.type):
        return F.size(v.col) > 0
    if is_null(v.type):
        return F.lit(None).cast("boolean")
    return F.when(v.col.isNotNull(), F.lit(True))


def sort_keys(v: V, descending: bool) -> list[Column]:
    """Null is the largest: last when ascending, first when descending."""
    v = entity(v)
    cols = [v.col["instant"], v.col["offset_s"]] if is_datetime(v.type) else [v.col]
    return [c.desc_nulls_first() if descending else c.asc_nulls_last() for c in cols]


# ---- arithmetic ----------------------------------------------------------------------------------


def _saturated(op: str, a: Column, b: Column) -> Column:
    out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)
    positive = {"+": a > 0, "-": a > 0, "*": (a > 0) == (b > 0)}[op]
    return F.coalesce(out, F.when(a.isNotNull() & b.isNotNull(), F.when(positive, F.lit(LONG_MAX)).otherwise(F.lit(LONG_MIN))))


def arithmetic(op: str, a: V, b: V) -> V:
    from . import temporal

    a, b = entity(a), entity(b)
    ta, tb = a.type, b.type
    if op == "+":
        if is_list(ta) and is_list(tb):
            t = T.ArrayType(common([ta.elementType, tb.elementType]))
            return V(F.concat(a.col.cast(t) if not is_null(t.elementType) else a.col, b.col.cast(t) if not is_null(t.elementType) else b.col), t)
        if is_list(ta):
            t = common([ta.elementType, tb])
            return V(F.concat(a.col.cast(T.ArrayType(t)), F.array(as_type(b, t))), T.ArrayType(t))
        if is_list(tb):
            t = common([tb.elementType, ta])
            return V(F.concat(F.array(as_type(a, t)), b.col.cast(T.ArrayType(t))), T.ArrayType(t))
    if is_null(ta) or is_null(tb):
        return NULL
    if op == "+" and (is_str(ta) or is_str(tb)) and family(ta) in ("string", "number") and family(tb) in ("string", "number"):
        return V(F.concat(to_text(a).col, to_text(b).col), T.StringType())
    if is_num(ta) and is_num(tb):
        if op == "^":
            return V(F.pow(a.col.cast("double"), b.col.cast("double")), T.DoubleType())
        if is_int(ta) and is_int(tb):
            if op in "+-*":
                return V(_saturated(op, a.col, b.col), T.LongType())
            safe = F.when(b.col == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise(b.col)
            if op == "/":
                return V(_div(a.col, safe), T.LongType())
            return V(a.col % safe, T.LongType())
        x, y = a.col.cast("double"), b.col.cast("double")
        if op in "/%":
            y = F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(y)
        return V({"+": x + y, "-": x - y, "*": x * y, "/": x / y, "%": x % y}[op], T.DoubleType())
    return temporal.arithmetic(op, a, b)


def _div(a: Column, b: Column) -> Column:
    """Integer division toward zero, exact for all 64-bit integers: (a - a % b) / b."""
    return ((a - a % b).cast("decimal(20,0)") / b.cast("decimal(20,0)")).cast("bigint")


def to_text(v: V) -> V:
    v = entity(v)
    t = v.type
    if is_null(t) or is_list(t) or is_map(t):
        return V(F.lit(None).cast("string"), T.StringType())
    if is_float(t):
        x = v.col.cast("double")
        plain = x.cast("string")
        whole = (x == F.floor(x)) & (F.abs(x) < 1e18)
        exact = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
        large = x.try_cast("decimal(38,0)").cast("string")
        return V(F.when(F.isnan(x), F.lit("NaN")).when(whole, F.when((x == 0) & plain.startswith("-"), F.lit("-0")).otherwise(x.cast("bigint").cast("string"))).when(plain.contains("E"), F.coalesce(F.when(F.abs(x) < 1e18, exact).otherwise(large), plain)).otherwise(plain), T.StringType())
    if is_str(t):
        return v
    if family(t) in ("date", "localdatetime", "datetime", "duration"):
        from . import temporal

        return temporal.to_text(v)
    return V(v.col.cast("string"), T.StringType())
