"""Scalar functions of the language, by name in lower case. Null in gives null out, and so does a wrong type, unless said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import temporal
from .values import NULL, V, as_type, common, entity, is_bool, is_float, is_int, is_list, is_map, is_null, is_num, is_str, to_text

STR, INT, FLOAT, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FUNCTIONS: dict[str, tuple[int, int, Callable[..., V]]] = {}
RANGE_MOST = 10_000_000


def function(*names: str, least: int, most: int | None = None):
    def put(f):
        for n in names:
            FUNCTIONS[n] = (least, least if most is None else most, f)
        return f

    return put


def _text(name: str, f: Callable[..., Column], out=STR, more: str = "") -> None:
    """A function of a text and further texts (s) or integers (i)."""

    def run(x: V, *rest: V) -> V:
        if not is_str(x.type) or any(not (is_str(r.type) if k == "s" else is_int(r.type)) for r, k in zip(rest, more, strict=False)):
            return NULL
        return V(f(x.col, *[r.col for r in rest]), out)

    FUNCTIONS[name] = (1 + len(more), 1 + len(more), run)


def _case(a: str, b: str):
    return lambda x: V(F.translate(x.col, a, b), STR) if is_str(x.type) else x


FUNCTIONS["tolower"] = (1, 1, _case(_UP, _LOW))
FUNCTIONS["toupper"] = (1, 1, _case(_LOW, _UP))
_SPACE = r"[\s\u0085   -     　\x0b]+"
_text("trim", lambda s: F.regexp_replace(s, f"^{_SPACE}|{_SPACE}$", ""))
_text("ltrim", lambda s: F.regexp_replace(s, f"^{_SPACE}", ""))
_text("rtrim", lambda s: F.regexp_replace(s, f"{_SPACE}$", ""))
_text("replace", lambda s, a, b: F.when(a == "", s).otherwise(F.replace(s, a, b)), more="ss")
_text("contains", lambda s, a: F.contains(s, a), BOOL, "s")
_text("startswith", lambda s, a: F.startswith(s, a), BOOL, "s")
_text("endswith", lambda s, a: F.endswith(s, a), BOOL, "s")
_text("left", lambda s, n: F.when(n >= 0, F.substring(s, F.lit(1), F.least(n, F.lit(2**31 - 1)).cast("int"))), more="i")
_text("right", lambda s, n: F.when(n >= 0, F.when(n >= F.length(s), s).otherwise(F.substring(s, F.length(s) - n.cast("int") + 1, n.cast("int")))), more="i")


@function("split", least=2)
def _split(s: V, d: V) -> V:
    if not (is_str(s.type) and is_str(d.type)):
        return NULL
    chars = F.filter(F.split(s.col, ""), lambda x: x != "")
    quoted = F.concat(F.lit("\\Q"), F.replace(d.col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return V(F.when(d.col == "", chars).otherwise(F.split(s.col, quoted, -1)), T.ArrayType(STR))


@function("substring", least=2, most=3)
def _substring(s: V, start: V, n: V | None = None) -> V:
    if not (is_str(s.type) and is_int(start.type) and (n is None or is_int(n.type))):
        return NULL
    length = F.length(s.col) if n is None else n.col
    ok = (start.col >= 0) & (start.col <= F.length(s.col)) & (length >= 0)
    return V(F.when(ok, F.substring(s.col, start.col.cast("int") + 1, F.least(length, F.lit(2**31 - 1)).cast("int"))), STR)


@function("reverse", least=1)
def _reverse(x: V) -> V:
    return V(F.reverse(x.col), x.type) if is_str(x.type) or is_list(x.type) else NULL


@function("size", least=1)
def _size(x: V) -> V:
    if is_str(x.type):
        return V(F.octet_length(x.col).cast("bigint"), INT)  # bytes
    if is_list(x.type) or x.kind == "rels":
        return V(F.when(x.col.isNotNull(), F.size(x.col)).cast("bigint"), INT)
    return NULL


FUNCTIONS["tostring"] = (1, 1, to_text)


def _parsed_int(c: Column) -> Column:
    x = F.trim(c)
    f = x.try_cast("double")
    whole = F.when(f < 0, F.ceil(f)).otherwise(F.floor(f))
    return F.coalesce(F.when(x.rlike(r"^[+-]?\d+$"), x.try_cast("bigint")), F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), whole.try_cast("bigint")))


@function("tointeger", least=1)
def _to_integer(x: V) -> V:
    if is_int(x.type):
        return x
    if is_float(x.type):
        return V(F.when(x.col < 0, F.ceil(x.col)).otherwise(F.floor(x.col)).cast("bigint"), INT)
    if is_bool(x.type):
        return V(x.col.cast("bigint"), INT)
    return V(_parsed_int(x.col), INT) if is_str(x.type) else NULL


@function("tofloat", least=1)
def _to_float(x: V) -> V:
    if is_num(x.type):
        return V(x.col.cast("double"), FLOAT)
    return V(F.trim(x.col).try_cast("double"), FLOAT) if is_str(x.type) else NULL


@function("toboolean", "tobooleanornull", least=1)
def _to_boolean(x: V) -> V:
    if is_bool(x.type):
        return x
    if is_int(x.type):
        return V(x.col != 0, BOOL)
    if is_str(x.type):
        low = F.lower(x.col)
        return V(F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False)), BOOL)
    return NULL


@function("tointegerornull", least=1)
def _to_integer_or_null(x: V) -> V:
    return V(F.when(x.col.rlike(r"^[+-]?\d+$"), x.col.try_cast("bigint")), INT) if is_str(x.type) else _to_integer(x)


@function("tofloatornull", least=1)
def _to_float_or_null(x: V) -> V:
    return V(F.when(x.col.rlike(r"^\S+$"), x.col.try_cast("double")), FLOAT) if is_str(x.type) else _to_float(x)


@function("abs", least=1)
def _abs(x: V) -> V:
    if is_int(x.type):
        return V(F.when(x.col == -(2**63), F.lit(2**63 - 1)).otherwise(F.abs(x.col)), INT)
    return V(F.abs(x.col), FLOAT) if is_float(x.type) else NULL


def _number(name: str, f: Callable[[Column], Column], out=FLOAT) -> None:
    FUNCTIONS[name] = (1, 1, lambda x: V(f(x.col.cast("double")), out) if is_num(x.type) else NULL)


_number("round", lambda x: F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)).cast("double"))
_number("sqrt", lambda x: F.when(x >= 0, F.sqrt(x)))
_number("log", lambda x: F.when(x > 0, F.ln(x)))
_number("log10", lambda x: F.when(x > 0, F.log10(x)))
for _name in ("exp", "sin", "cos", "tan", "atan"):
    _number(_name, getattr(F, _name))
for _name in ("floor", "ceil"):
    FUNCTIONS[_name] = (1, 1, (lambda f: lambda x: x if is_int(x.type) else V(f(x.col).cast("bigint"), INT) if is_float(x.type) else NULL)(getattr(F, _name)))
FUNCTIONS["sign"] = (1, 1, lambda x: V(F.signum(x.col.cast("double")).cast("bigint"), INT) if is_num(x.type) else NULL)
FUNCTIONS["atan2"] = (2, 2, lambda y, x: V(F.atan2(y.col.cast("double"), x.col.cast("double")), FLOAT) if is_num(x.type) and is_num(y.type) else NULL)
FUNCTIONS["pi"] = (0, 0, lambda: V(F.pi(), FLOAT))
FUNCTIONS["e"] = (0, 0, lambda: V(F.e(), FLOAT))
FUNCTIONS["rand"] = (0, 0, lambda: V(F.rand(), FLOAT))


@function("decay", least=3)
def _decay(base: V, age: V, half: V) -> V:
    if not all(is_num(x.type) for x in (base, age, half)):
        return NULL
    h = half.col.cast("double")
    h = F.when(h <= 0, F.raise_error(F.lit("decay: the half-life is above zero")).cast("double")).otherwise(h)
    return V(base.col.cast("double") * F.pow(F.lit(0.5), age.col.cast("double") / h), FLOAT)


@function("coalesce", least=1, most=99)
def _coalesce(*xs: V) -> V:
    xs = [entity(x) for x in xs]
    t = common([x.type for x in xs])
    return NULL if is_null(t) else V(F.coalesce(*[as_type(x, t) for x in xs if not is_null(x.type)]), t)


def _element(name: str, f: Callable[[Column], Column]) -> None:
    FUNCTIONS[name] = (1, 1, lambda x: V(f(x.col), x.type.elementType) if is_list(x.type) else NULL)


_element("head", lambda c: F.try_element_at(c, F.lit(1)))
_element("last", lambda c: F.try_element_at(c, F.lit(-1)))
FUNCTIONS["tail"] = (1, 1, lambda x: V(F.when(F.size(x.col) > 1, F.slice(x.col, 2, F.greatest(F.size(x.col) - 1, F.lit(0)))).when(x.col.isNotNull(), F.slice(x.col, 1, 0)), x.type) if is_list(x.type) else NULL)


@function("range", least=2, most=3)
def _range(a: V, b: V, step: V | None = None) -> V:
    if not all(is_int(x.type) for x in (a, b, *([step] if step else []))):
        return NULL
    s = step.col if step else F.lit(1).cast("bigint")
    if step and step.const == 0:
        raise ValueError("range takes a step other than zero")
    s = F.when(s == 0, F.raise_error(F.lit("range takes a step other than zero")).cast("bigint")).otherwise(s) if step and not step.is_const else s
    wrong = ((s > 0) & (a.col > b.col)) | ((s < 0) & (a.col < b.col))
    many = (b.col - a.col) / s > RANGE_MOST
    empty = F.array().cast("array<bigint>")
    return V(F.when(wrong, empty).when(many, F.raise_error(F.lit("range is too long")).cast("array<bigint>")).otherwise(F.sequence(a.col, b.col, s)), T.ArrayType(INT))


@function("keys", least=1)
def _keys(x: V) -> V:
    if x.kind in ("node", "rel"):
        present = [F.when(x.col[f"p_{n}"].isNotNull(), F.lit(n)) for n in sorted(x.props)]
        return V(F.when(x.col.isNotNull(), F.filter(F.array(*present), lambda c: c.isNotNull()) if present else F.array().cast("array<string>")), T.ArrayType(STR))
    if isinstance(x.type, T.StructType) and is_map(x.type):
        return V(F.when(x.col.isNotNull(), F.array(*[F.lit(n) for n in sorted(x.type.fieldNames())])), T.ArrayType(STR))
    return V(F.sort_array(F.map_keys(x.col)), T.ArrayType(STR)) if isinstance(x.type, T.MapType) else NULL


@function("properties", least=1)
def _properties(x: V) -> V:
    if x.kind in ("node", "rel"):
        names = sorted(x.props)
        if not names:
            return V(F.create_map().cast("map<string,string>"), T.MapType(STR, STR))
        return V(F.when(x.col.isNotNull(), F.struct(*[x.col[f"p_{n}"].alias(n) for n in names])), T.StructType([T.StructField(n, x.props[n]) for n in names]))
    return x if is_map(x.type) else NULL


@function("key", "id", least=1)
def _key(x: V) -> V:
    return V(x.col["key"], STR) if x.kind == "node" else NULL


@function("labels", least=1)
def _labels(x: V) -> V:
    return V(F.when(x.col.isNotNull(), F.filter(F.array(x.col["label"]), lambda c: c.isNotNull())), T.ArrayType(STR)) if x.kind == "node" else NULL


@function("type", least=1)
def _type(x: V) -> V:
    return V(x.col["etype"], STR) if x.kind == "rel" else NULL


@function("elementid", least=1)
def _element_id(x: V) -> V:
    if x.kind == "node":
        return V(F.concat(F.lit("n:"), x.col["key"]), STR)
    return V(F.concat(F.lit("r:"), x.col["etype"], F.lit("|"), x.col["src"], F.lit("|"), x.col["dst"]), STR) if x.kind == "rel" else NULL


FUNCTIONS["startnode"] = (1, 1, lambda x: V(x.col["src"], STR) if x.kind == "rel" else NULL)
FUNCTIONS["endnode"] = (1, 1, lambda x: V(x.col["dst"], STR) if x.kind == "rel" else NULL)
FUNCTIONS["nodes"] = (1, 1, lambda x: V(x.col["nodes"], T.ArrayType(STR)) if x.kind == "path" else NULL)
FUNCTIONS["relationships"] = (1, 1, lambda x: V(x.col["relationships"], x.type["relationships"].dataType) if x.kind == "path" else NULL)


@function("length", least=1)
def _length(x: V) -> V:
    if x.kind == "path":
        return V(x.col["length"], INT)
    return V(F.size(x.col).cast("bigint"), INT) if x.kind == "rels" else NULL


@function("textmatches", least=2, most=3)
def _text_matches(field: V, query: V, stem: V | None = None) -> V:
    from ..operators.search import matches

    if not isinstance(query.const, str):
        raise ValueError("textMatches takes its query as a literal or parameter")
    if not is_str(field.type) and not (is_list(field.type) and is_str(field.type.elementType)):
        return NULL
    if stem is not None and not isinstance(stem.const, bool):
        raise ValueError("textMatches takes true or false for stemming")
    return V(matches(field.col, query.const, stem is None or stem.const), BOOL)


def call(name: str, args: list[V]) -> V:
    if "." in name or name in ("date", "datetime", "localdatetime", "duration"):
        out = temporal.call(name, args)
        if out is not None:
            return out
    if name not in FUNCTIONS:
        raise ValueError(f"no function {name}()")
    least, most, f = FUNCTIONS[name]
    if not least <= len(args) <= most:
        raise ValueError(f"{name}() takes {least if least == most else f'{least} to {most}'} arguments")
    if any(is_null(a.type) and a.kind == "value" for a in args) and name not in ("coalesce",):
        return NULL
    return f(*args)


