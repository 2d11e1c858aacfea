"""Dates, date-times and durations.

A duration is a struct of months, days and nanoseconds that are never carried over; a date-time with
an offset is a struct of its instant and the offset in seconds; a local date-time is a timestamp
without zone. Spark keeps microseconds, so nanoseconds below them are dropped from date-times.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import DATETIME, DURATION, NULL, V, family, is_duration, is_map, is_null, is_num, is_str, let

SECOND, DAY = 1_000_000_000, 86_400_000_000_000
MONTH_SECONDS = 365.2425 / 12 * 86400
DATE, LDT, DT = T.DateType(), T.TimestampNTZType(), DATETIME


def _micros(c: Column) -> Column:
    """Microseconds since 1970 of a local date-time."""
    return F.unix_micros(c.cast("timestamp"))  # the session's zone is UTC


def _from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def duration_of(months: Column, days: Column, nanos: Column) -> V:
    return V(F.struct(months.cast("bigint").alias("months"), days.cast("bigint").alias("days"), nanos.cast("bigint").alias("nanos")), DURATION)


def _fields(v: V) -> dict[str, V]:
    return {f.name: V(v.col[f.name], f.dataType, const=(v.const or {}).get(f.name) if isinstance(v.const, dict) else None) for f in v.type.fields} if isinstance(v.type, T.StructType) else {}


def parse_duration(text: str) -> tuple[int, int, int]:
    m = re.fullmatch(r"(-?)P(?:(-?[\d.]+)Y)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)W)?(?:(-?[\d.]+)D)?(?:T(?:(-?[\d.]+)H)?(?:(-?[\d.]+)M)?(?:(-?[\d.]+)S)?)?", text)
    if not m or text in ("P", "-P") or text.endswith("T"):
        raise ValueError(f"no duration: {text!r}")
    sign = -1 if m[1] else 1
    y, mo, w, d, h, mi, s = (sign * float(x) if x else 0.0 for x in m.groups()[1:])
    return fold_duration({"years": y, "months": mo, "weeks": w, "days": d, "hours": h, "minutes": mi, "seconds": s})


def fold_duration(f: dict[str, float]) -> tuple[int, int, int]:
    """Months, days, nanoseconds; fractions go on to the next smaller part, months by their mean length."""
    months = f.get("years", 0) * 12 + f.get("quarters", 0) * 3 + f.get("months", 0)
    whole = int(months)
    days = (months - whole) * MONTH_SECONDS / 86400 + f.get("weeks", 0) * 7 + f.get("days", 0)
    whole_days = int(days)
    seconds = (days - whole_days) * 86400 + f.get("hours", 0) * 3600 + f.get("minutes", 0) * 60 + f.get("seconds", 0)
    whole_seconds = int(seconds)
    nanos = round((seconds - whole_seconds) * 1e9) + f.get("milliseconds", 0) * 1e6 + f.get("microseconds", 0) * 1e3 + f.get("nanoseconds", 0)
    return whole, whole_days, whole_seconds * SECOND + int(nanos)


def _toward(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("bigint")


def _folded(months: Column, days: Column, seconds: Column, nanos: Column) -> V:
    """A duration from parts with fractions, which go on to the next smaller part."""
    one = F.struct(months.alias("m"), days.alias("d"), seconds.alias("s"), nanos.alias("n"))
    two = lambda x: F.struct(_toward(x["m"]).alias("m"), (x["d"] + (x["m"] - _toward(x["m"])) * (MONTH_SECONDS / 86400)).alias("d"), x["s"].alias("s"), x["n"].alias("n"))
    three = lambda x: F.struct(x["m"].alias("m"), _toward(x["d"]).alias("d"), (x["s"] + (x["d"] - _toward(x["d"])) * 86400).alias("s"), x["n"].alias("n"))
    last = lambda x: duration_of(x["m"], x["d"], _toward(x["s"]) * SECOND + F.round((x["s"] - _toward(x["s"])) * 1e9 + x["n"]).cast("bigint")).col
    return V(let(let(let(one, two), three), last), DURATION)


def duration(v: V) -> V:
    if is_duration(v.type) or is_null(v.type):
        return v
    if isinstance(v.const, str):
        m, d, n = parse_duration(v.const)
        return duration_of(F.lit(m), F.lit(d), F.lit(n))
    if is_str(v.type):
        part = lambda unit, t: F.coalesce(F.regexp_extract(v.col, rf"{t}(-?[\d.]+){unit}", 1).try_cast("double"), F.lit(0.0))
        date = r"^P[^T]*?"
        time = r"T[^P]*?"
        months = part("Y", date) * 12 + part("M", date)
        days = part("W", date) * 7 + part("D", date)
        seconds = part("H", time) * 3600 + part("M", time) * 60 + part("S", time)
        return duration_of(months, days, F.round(seconds * SECOND))
    if is_map(v.type):
        f = _fields(v)
        if isinstance(v.const, dict) and all(isinstance(x, (int, float)) for x in v.const.values()):
            return duration_of(*[F.lit(x) for x in fold_duration(v.const)])
        x = {k: F.coalesce(c.col.cast("double"), F.lit(0.0)) for k, c in f.items()}
        g = lambda k: x.get(k, F.lit(0.0))
        fine = g("milliseconds") * 1e6 + g("microseconds") * 1e3 + g("nanoseconds")
        return _folded(g("years") * 12 + g("quarters") * 3 + g("months"), g("weeks") * 7 + g("days"), g("hours") * 3600 + g("minutes") * 60 + g("seconds"), fine)
    return NULL


def _date_of(f: dict[str, V], base: Column | None) -> Column:
    """A date from a map: calendar, ISO week, quarter or day of the year; base for what is missing."""
    get = lambda k, other: f[k].col.cast("int") if k in f else other
    year = get("year", F.year(base) if base is not None else F.lit(1970))
    if "week" in f or "dayOfWeek" in f and "month" not in f:
        week = get("week", F.weekofyear(base) if base is not None else F.lit(1))
        day = get("dayOfWeek", (F.weekday(base) + 1) if base is not None else F.lit(1))
        fourth = F.make_date(year, F.lit(1), F.lit(4))
        return F.date_add(F.date_sub(fourth, F.weekday(fourth)), (week - 1) * 7 + day - 1)
    if "quarter" in f:
        month = (f["quarter"].col.cast("int") - 1) * 3 + 1
        first = F.make_date(year, month, F.lit(1))
        return F.date_add(first, get("dayOfQuarter", F.lit(1)) - 1) if "dayOfQuarter" in f or base is None else F.make_date(year, month + (F.month(base) - 1) % 3, F.dayofmonth(base))
    if "ordinalDay" in f:
        return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), f["ordinalDay"].col.cast("int") - 1)
    month = get("month", F.month(base) if base is not None else F.lit(1))
    day = get("day", F.dayofmonth(base) if base is not None else F.lit(1))
    return F.make_date(year, month, day)


def _time_micros(f: dict[str, V], base: Column | None) -> Column:
    """Microseconds of the day from a map."""
    get = lambda k, other: f[k].col.cast("bigint") if k in f else other
    of = base if base is not None else F.lit(0).cast("bigint")
    h = get("hour", F.floor(of / 3_600_000_000))
    m = get("minute", F.floor(of / 60_000_000) % 60)
    s = get("second", F.floor(of / 1_000_000) % 60)
    if any(k in f for k in ("millisecond", "microsecond", "nanosecond")):
        part = get("millisecond", F.lit(0)) * 1000 + get("microsecond", F.lit(0)) + F.floor(get("nanosecond", F.lit(0)) / 1000)
    else:
        part = of % 1_000_000
    return (((h * 60 + m) * 60 + s) * 1_000_000 + part).cast("bigint")


def local(v: V) -> Column:
    """Any temporal value as a local date-time."""
    k = family(v.type)
    if k == "datetime":
        return _from_micros(F.unix_micros(v.col["instant"]) + v.col["offset_s"].cast("bigint") * 1_000_000)
    return v.col.cast("timestamp_ntz")


def date(v: V | None) -> V:
    if v is None:
        return V(F.current_date(), DATE)
    k = family(v.type)
    if k == "string":
        t = v.col
        week = F.regexp_extract(t, r"^(\d{4})-?W(\d{2})(?:-?(\d))?$", 1)
        ordinal = F.regexp_extract(t, r"^(\d{4})-?(\d{3})$", 1)
        iso = {"year": V(week, T.StringType()), "week": V(F.regexp_extract(t, r"W(\d{2})", 1), T.StringType()), "dayOfWeek": V(F.when(F.regexp_extract(t, r"W\d{2}-?(\d)$", 1) == "", F.lit("1")).otherwise(F.regexp_extract(t, r"W\d{2}-?(\d)$", 1)), T.StringType())}
        day = F.when(week != "", _date_of(iso, None)).when(ordinal != "", F.date_add(F.make_date(ordinal.cast("int"), F.lit(1), F.lit(1)), F.right(t, F.lit(3)).cast("int") - 1)) if not isinstance(v.const, str) or not re.fullmatch(r"\d{4}-\d{2}-\d{2}", v.const) else None
        plain = F.to_date(F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
        return V(plain if day is None else F.when((week != "") | (ordinal != ""), day).otherwise(plain), DATE)
    if k == "map":
        f = _fields(v)
        base = next((local(f.pop(n)).cast("date") for n in ("date", "datetime") if n in f), None)
        return V(_date_of(f, base), DATE)
    return NULL if k == "null" else V(local(v).cast("date"), DATE)


def _parts(v: V) -> tuple[Column, Column, dict[str, V]]:
    """The date, the microseconds of the day, and the fields of a map."""
    f = _fields(v)
    base_date = next((local(f[n]).cast("date") for n in ("date", "datetime") if n in f), None)
    base_time = next((_micros(local(f[n])) % 86_400_000_000 for n in ("time", "datetime") if n in f), None)
    return _date_of(f, base_date), _time_micros(f, base_time), f


def local_datetime(v: V | None) -> V:
    if v is None:
        return V(F.localtimestamp(), LDT)
    k = family(v.type)
    if k == "string":
        return V(F.to_timestamp_ntz(F.regexp_replace(v.col, "T", " ")), LDT)
    if k == "map":
        d, micros, _ = _parts(v)
        return V(_from_micros(_micros(d.cast("timestamp_ntz")) + micros), LDT)
    return NULL if k == "null" else V(local(v), LDT)


def _offset(text: Column) -> Column:
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    digits = F.rpad(F.regexp_replace(text, r"[^0-9]", ""), 4, "0")
    return F.when((text == "Z") | (text == ""), F.lit(0)).otherwise(sign * (F.substring(digits, 1, 2).cast("int") * 3600 + F.substring(digits, 3, 2).cast("int") * 60))


def _zoned(local_micros: Column, offset: Column) -> V:
    return V(F.struct(F.timestamp_micros(local_micros - offset.cast("bigint") * 1_000_000).alias("instant"), offset.cast("int").alias("offset_s")), DT)


def datetime(v: V | None) -> V:
    if v is None:
        return V(F.struct(F.current_timestamp().alias("instant"), F.lit(0).alias("offset_s")), DT)
    k = family(v.type)
    if k == "string":
        zone = F.regexp_extract(v.col, r"(Z|[+-]\d{2}:?\d{0,2})$", 1)
        zone = F.when(v.col.contains("T"), zone).otherwise(F.lit(""))
        plain = F.regexp_replace(F.when(v.col.contains("T"), F.regexp_replace(v.col, r"(Z|[+-]\d{2}:?\d{0,2})$", "")).otherwise(v.col), "T", " ")
        return _zoned(_micros(F.to_timestamp_ntz(plain)), _offset(zone))
    if k == "map":
        d, micros, f = _parts(v)
        if "epochSeconds" in f or "epochMillis" in f:
            base = f["epochSeconds"].col * 1_000_000 if "epochSeconds" in f else f["epochMillis"].col * 1000
            return V(F.struct(F.timestamp_micros(base.cast("bigint")).alias("instant"), F.lit(0).alias("offset_s")), DT)
        offset = _offset(f["timezone"].col) if "timezone" in f else F.lit(0)
        return _zoned(_micros(d.cast("timestamp_ntz")) + micros, offset)
    if k == "datetime":
        return v
    return NULL if k == "null" else _zoned(_micros(local(v)), F.lit(0))


def truncate(kind: str, unit: str, v: V, over: V | None) -> V:
    u = unit.lower()
    at = local(v)
    d = at.cast("date")
    year = F.year(d)
    if u in ("millennium", "century", "decade"):
        n = {"millennium": 1000, "century": 100, "decade": 10}[u]
        base = F.make_date(F.floor(year / n).cast("int") * n, F.lit(1), F.lit(1)).cast("timestamp_ntz")
    elif u == "weekyear":
        thursday = F.date_add(d, 3 - F.weekday(d))
        fourth = F.make_date(F.year(thursday), F.lit(1), F.lit(4))
        base = F.date_sub(fourth, F.weekday(fourth)).cast("timestamp_ntz")
    elif u in ("year", "quarter", "month", "week"):
        base = F.trunc(d, u).cast("timestamp_ntz")
    elif u == "day":
        base = d.cast("timestamp_ntz")
    elif u in ("hour", "minute", "second", "millisecond", "microsecond"):
        step = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}[u]
        base = _from_micros(_micros(at) - F.pmod(_micros(at), F.lit(step)))
    else:
        raise ValueError(f"no unit: {unit}")
    if over is not None:
        f = _fields(over)
        day = _date_of(f, base.cast("date")) if any(k in f for k in ("year", "month", "day", "week", "dayOfWeek", "quarter", "ordinalDay", "dayOfQuarter")) else base.cast("date")
        if "dayOfWeek" in f and "month" not in f and "week" not in f:
            day = F.date_add(F.date_sub(base.cast("date"), F.weekday(base.cast("date"))), f["dayOfWeek"].col.cast("int") - 1)
        base = _from_micros(_micros(day.cast("timestamp_ntz")) + _time_micros(f, F.pmod(_micros(base), F.lit(86_400_000_000))))
    if kind == "date":
        return V(base.cast("date"), DATE)
    if kind == "localdatetime":
        return V(base, LDT)
    offset = v.col["offset_s"] if family(v.type) == "datetime" else F.lit(0)
    if over is not None and "timezone" in _fields(over):
        offset = _offset(_fields(over)["timezone"].col)
    return _zoned(_micros(base), offset)


def between(how: str, a: V, b: V) -> V:
    """Whole units from a to b, cut toward zero."""
    both = F.struct(a.col.alias("a"), b.col.alias("b"))
    return V(let(both, lambda x: _between(how, V(x["a"], a.type), V(x["b"], b.type)).col), DURATION)


def _between(how: str, a: V, b: V) -> V:
    if family(a.type) == family(b.type) == "datetime":
        x, y = F.unix_micros(a.col["instant"]), F.unix_micros(b.col["instant"])
        la, lb = _from_micros(x), _from_micros(y)
    else:
        la, lb = local(a), local(b)
        x, y = _micros(la), _micros(lb)
    months = ((F.year(lb) - F.year(la)) * 12 + F.month(lb) - F.month(la)).cast("bigint")
    rest = lambda c: (F.dayofmonth(c).cast("bigint") - 1) * 86_400_000_000 + F.pmod(_micros(c), F.lit(86_400_000_000))
    months = F.when((months > 0) & (rest(lb) < rest(la)), months - 1).when((months < 0) & (rest(lb) > rest(la)), months + 1).otherwise(months)
    cut = lambda c, n: F.when(c < 0, -F.floor(-c / n)).otherwise(F.floor(c / n)).cast("bigint")
    if how == "inmonths":
        return duration_of(months, F.lit(0), F.lit(0))
    if how == "indays":
        return duration_of(F.lit(0), cut(y - x, 86_400_000_000), F.lit(0))
    if how == "inseconds":
        return duration_of(F.lit(0), F.lit(0), (y - x) * 1000)
    rest_of = let(months, lambda m: F.struct(m.alias("m"), (y - _micros(_plus_months(la, m))).alias("left")))
    return V(let(rest_of, lambda x: duration_of(x["m"], cut(x["left"], 86_400_000_000), (x["left"] - cut(x["left"], 86_400_000_000) * 86_400_000_000) * 1000).col), DURATION)


def _plus_months(local_time: Column, months: Column) -> Column:
    """The same day months later, or the last of that month; the time of the day stays."""
    d = local_time.cast("date")
    return _from_micros(_micros(F.add_months(d, months.cast("int")).cast("timestamp_ntz")) + F.pmod(_micros(local_time), F.lit(86_400_000_000)))


def arithmetic(op: str, a: V, b: V) -> V:
    fa, fb = family(a.type), family(b.type)
    if fa == fb == "duration" and op in "+-":
        f = (lambda x, y: x + y) if op == "+" else (lambda x, y: x - y)
        return duration_of(*[f(a.col[k], b.col[k]) for k in ("months", "days", "nanos")])
    if fa == "duration" and is_num(b.type) and op in "*/":
        k = b.col.cast("double") if op == "*" else 1 / b.col.cast("double")
        return _folded(a.col["months"] * k, a.col["days"] * k, F.lit(0.0), a.col["nanos"] * k)
    if fb == "duration" and is_num(a.type) and op == "*":
        return arithmetic("*", b, a)
    if fa == "duration" and op == "+":
        return arithmetic("+", b, a)
    if fb == "duration" and fa in ("date", "localdatetime", "datetime") and op in "+-":
        sign = 1 if op == "+" else -1
        m, d, n = (b.col[k] * sign for k in ("months", "days", "nanos"))
        if fa == "date":
            return V(F.date_add(F.add_months(a.col, m.cast("int")), d.cast("int")), DATE)
        moved = _plus_months(local(a), m)
        moved = _micros(moved) + d * 86_400_000_000 + F.floor(n / 1000)
        return V(_from_micros(moved), LDT) if fa == "localdatetime" else _zoned(moved, a.col["offset_s"])
    return NULL


def _duration_text(v: Column) -> Column:
    m, d, n = v["months"], v["days"], v["nanos"]
    part = lambda c, unit: F.when(c != 0, F.concat(c.cast("string"), F.lit(unit))).otherwise(F.lit(""))
    toward = lambda c, by: F.when(c < 0, -F.floor(-c / by)).otherwise(F.floor(c / by)).cast("bigint")
    s = n % (60 * SECOND)
    seconds = F.regexp_replace(F.regexp_replace((s.cast("decimal(20,0)") / F.lit(SECOND).cast("decimal(20,0)")).cast("decimal(20,9)").cast("string"), "0+$", ""), r"\.$", "")
    time = F.concat(part(toward(n, 3600 * SECOND), "H"), part(toward(n % (3600 * SECOND), 60 * SECOND), "M"), F.when(s != 0, F.concat(seconds, F.lit("S"))).otherwise(F.lit("")))
    date = F.concat(F.lit("P"), part(toward(m, 12), "Y"), part(m % 12, "M"), part(d, "D"))
    return let(F.struct(date.alias("d"), time.alias("t")), lambda x: F.when((x["d"] == "P") & (x["t"] == ""), F.lit("PT0S")).when(x["t"] != "", F.concat(x["d"], F.lit("T"), x["t"])).otherwise(x["d"]))


def to_text(v: V) -> V:
    k = family(v.type)
    if k == "date":
        return V(F.date_format(v.col, "yyyy-MM-dd"), T.StringType())
    if k == "duration":
        return V(let(v.col, _duration_text), T.StringType())
    at = local(v)
    text = F.regexp_replace(F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"0+$", ""), r"\.$", "")
    if k == "localdatetime":
        return V(text, T.StringType())
    o = v.col["offset_s"]
    zone = F.when(o == 0, F.lit("Z")).otherwise(F.concat(F.when(o < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.floor(F.abs(o) / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(F.abs(o) / 60) % 60).cast("string"), 2, "0")))
    return V(F.concat(text, zone), T.StringType())


def call(name: str, args: list[V]) -> V | None:
    """Temporal functions by name in lower case; None if there is no such function."""
    one = args[0] if args else None
    makers = {"date": date, "localdatetime": local_datetime, "datetime": datetime}
    if name in makers:
        return makers[name](one)
    if name == "duration":
        return duration(one)
    base, _, what = name.partition(".")
    if base in makers:
        if what == "truncate":
            if not isinstance(one.const, str):
                raise ValueError("truncate takes its unit as a literal")
            return truncate(base, one.const, args[1] if len(args) > 1 else makers[base](None), args[2] if len(args) > 2 else None)
        if what in ("statement", "transaction", "realtime"):
            return makers[base](None)
    if name == "datetime.fromepoch":
        return V(F.struct(F.timestamp_micros(args[0].col * 1_000_000 + F.floor(args[1].col / 1000)).alias("instant"), F.lit(0).alias("offset_s")), DT)
    if name == "datetime.fromepochmillis":
        return V(F.struct(F.timestamp_micros(args[0].col * 1000).alias("instant"), F.lit(0).alias("offset_s")), DT)
    if base == "duration" and what in ("between", "inmonths", "indays", "inseconds"):
        if any(is_null(x.type) for x in args):
            return NULL
        return between(what, *args)
    return None

