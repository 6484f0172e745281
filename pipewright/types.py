"""The language's types on Spark's, casts and text forms.

datetime is TIMESTAMP_NTZ, timespan a day-time interval, guid a lower-case string.  dynamic is a native array where
the elements' type is known, else JSON text; columns of JSON text carry the metadata ``{"pipewright": "dynamic"}``.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPAN = T.DayTimeIntervalType(0, 3)
SPARK = {
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "real": T.DoubleType(),
    "double": T.DoubleType(),
    "decimal": T.DecimalType(38, 18),
    "datetime": T.TimestampNTZType(),
    "date": T.TimestampNTZType(),
    "timespan": SPAN,
    "time": SPAN,
    "string": T.StringType(),
    "guid": T.StringType(),
    "dynamic": T.StringType(),
}
DYNAMIC = {"pipewright": "dynamic"}
#: Microseconds between 0001-01-01, where bins start, and 1970-01-01.
EPOCH = 62_135_596_800_000_000
_CLR = {"bool": "System.SByte", "int": "System.Int32", "long": "System.Int64", "real": "System.Double", "decimal": "System.Data.SqlTypes.SqlDecimal", "datetime": "System.DateTime", "timespan": "System.TimeSpan", "string": "System.String", "dynamic": "System.Object"}


def is_integral(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.TimestampNTZType, T.TimestampType, T.DateType))


def is_span(t: T.DataType) -> bool:
    return isinstance(t, T.DayTimeIntervalType)


def name_of(t: T.DataType, dynamic: bool = False) -> str:
    """The language's name of a Spark type."""
    if dynamic or isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return "dynamic"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.LongType):
        return "long"
    if is_integral(t):
        return "int"
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return "real"
    if isinstance(t, T.DecimalType):
        return "decimal"
    if is_time(t):
        return "datetime"
    if is_span(t):
        return "timespan"
    return "string"


def clr_name(kind: str) -> str:
    return _CLR[kind]


# Literals.
_DATE = re.compile(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2})(?:[T ](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,7}))?)?)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?$")


def parse_datetime(text: str) -> dt.datetime | None:
    """A literal's value: year, year-month and finer ISO forms, month/day/year; an offset is applied."""
    m = _DATE.match(text.strip())
    if not m:
        m = re.match(r"(\d{1,2})/(\d{1,2})/(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?$", text.strip())
        if not m:
            return None
        mo, d, y, h, mi, s = m.groups()
        return dt.datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0))
    y, mo, d, h, mi, s, f, zone = m.groups()
    out = dt.datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((f or "0").ljust(7, "0")) // 10)
    if zone and zone != "Z":
        sign = -1 if zone[0] == "-" else 1
        digits = zone[1:].replace(":", "")
        out -= sign * dt.timedelta(hours=int(digits[:2]), minutes=int(digits[2:]))
    return out


def datetime_lit(value: dt.datetime | None) -> Column:
    if value is None:
        return F.lit(None).cast(T.TimestampNTZType())
    return F.lit(value.isoformat(sep=" ")).cast(T.TimestampNTZType())


def span_lit(micros: int | None) -> Column:
    if micros is None:
        return F.lit(None).cast(SPAN)
    return F.lit(dt.timedelta(microseconds=micros))


def literal(value: Any, kind: str) -> Column:
    """A literal column of the language's type ``kind``."""
    if kind in ("datetime", "date"):
        return datetime_lit(parse_datetime(value) if isinstance(value, str) else value)
    if kind in ("timespan", "time"):
        return span_lit(value)
    if kind == "dynamic":
        return dynamic_lit(value)[0]
    if kind == "real" and isinstance(value, int):
        value = float(value)
    if kind == "long" and isinstance(value, int) and not -(1 << 63) <= value < 1 << 63:
        value = None
    if kind == "decimal" and value is not None:
        value = repr(value)
    return F.lit(value).cast(SPARK[kind])


def dynamic_lit(value: Any) -> tuple[Column, bool]:
    """A dynamic constant and whether it is JSON text: arrays of one plain type are native."""
    if value is None:
        return F.lit(None).cast("string"), True
    if isinstance(value, list):
        kinds = {type(x) for x in value if x is not None}
        if kinds <= {int}:
            return F.array(*[F.lit(x).cast("long") for x in value]) if value else F.array().cast("array<string>"), False
        if kinds <= {int, float}:
            return F.array(*[F.lit(None if x is None else float(x)).cast("double") for x in value]), False
        for kind, spark in ((str, "string"), (bool, "boolean")):
            if kinds == {kind}:
                return F.array(*[F.lit(x).cast(spark) for x in value]), False
        return F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False)), True
    if isinstance(value, dict):
        return F.lit(json.dumps(value, separators=(",", ":"), ensure_ascii=False)), True
    return F.lit(value), False


# Microseconds.  Sessions run in UTC while a query is lowered, so NTZ and TIMESTAMP coincide.
def micros(t: Column) -> Column:
    """Microseconds since 1970 of a datetime."""
    return F.unix_micros(t.cast("timestamp"))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us).cast("timestamp_ntz")


def span_micros(i: Column) -> Column:
    return F.unix_micros(F.timestamp_micros(F.lit(0).cast("long")) + i)


def micros_span(us: Column) -> Column:
    """A timespan of so many microseconds."""
    return (F.timestamp_micros(us) - F.timestamp_micros(F.lit(0).cast("long"))).cast(SPAN)


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def span_text(i: Column) -> Column:
    """``[-][d.]hh:mm:ss[.fffffff]``"""
    us = span_micros(i)
    a = F.abs(us)
    days = F.floor(a / F.lit(86_400_000_000)).cast("long")
    rest = F.pmod(a, F.lit(86_400_000_000))
    fraction = F.pmod(a, F.lit(1_000_000))
    return F.concat(
        F.when(us < 0, "-").otherwise(""),
        F.when(days > 0, F.concat(days.cast("string"), F.lit("."))).otherwise(""),
        _pad(F.floor(rest / F.lit(3_600_000_000)), 2),
        F.lit(":"),
        _pad(F.floor(F.pmod(rest, F.lit(3_600_000_000)) / F.lit(60_000_000)), 2),
        F.lit(":"),
        _pad(F.floor(F.pmod(rest, F.lit(60_000_000)) / F.lit(1_000_000)), 2),
        F.when(fraction > 0, F.concat(F.lit("."), _pad(fraction, 6), F.lit("0"))).otherwise(""),
    )


def text(x: Column, t: T.DataType) -> Column:
    """``tostring``: a null is the empty string."""
    if isinstance(t, T.BooleanType):
        out = F.when(x, "True").when(~x, "False")
    elif is_time(t):
        out = F.concat(F.date_format(x.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0Z"))
    elif is_span(t):
        out = span_text(x)
    elif isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        out = F.to_json(x)
    elif isinstance(t, T.StringType):
        out = x
    elif isinstance(t, T.NullType):
        return F.lit("")
    else:
        out = x.cast("string")
    return F.coalesce(out, F.lit(""))


_FORMATS = ("M/d/yyyy h:mm:ss a", "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "yyyy/M/d H:mm:ss", "yyyy/M/d", "d MMM yyyy H:mm:ss", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd")


def cast(x: Column, t: T.DataType, kind: str) -> Column:
    """Conversion to the language's type ``kind``: null where it fails.  Numbers are cut towards zero."""
    string = isinstance(t, T.StringType)
    if kind in ("bool", "boolean"):
        if string:
            low = F.lower(F.trim(x))
            return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False).otherwise(F.coalesce(x.try_cast("double") != 0, F.lit(None).cast("boolean")))
        return x.cast("double") != 0 if is_number(t) else x.try_cast("boolean") if not isinstance(t, T.BooleanType) else x
    if kind in ("int", "long"):
        to = SPARK[kind]
        if string:
            low = F.lower(F.trim(x))
            number = F.coalesce(x.try_cast(to), x.try_cast("double").try_cast(to), F.when(low == "true", 1).when(low == "false", 0).cast(to))
            return F.when(low.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(low, 3, 16), 16, 10).try_cast(to)).otherwise(number)
        if is_time(t):
            return ((micros(x.cast("timestamp_ntz")) + F.lit(EPOCH)) * 10).cast("long").try_cast(to)
        if is_span(t):
            return (span_micros(x) * 10).try_cast(to)
        if isinstance(t, T.BooleanType):
            return x.cast("int").cast(to)
        return x.try_cast(to)
    if kind in ("real", "double"):
        return x.cast("int").cast("double") if isinstance(t, T.BooleanType) else x.try_cast("double")
    if kind == "decimal":
        return x.try_cast("decimal(38,18)")
    if kind in ("datetime", "date"):
        if is_number(t):
            return from_micros(F.floor(x / F.lit(10)).cast("long") - F.lit(EPOCH))
        if string:
            # Without a zone or the name of the day.
            bare = F.regexp_replace(F.trim(x), r"(?i)z$|^[a-z]{3}, | gmt$", "")
            return F.coalesce(
                bare.try_cast("timestamp_ntz"),
                *[F.try_to_timestamp(bare, F.lit(f)).cast("timestamp_ntz") for f in _FORMATS],
            )
        return x.cast("timestamp_ntz")
    if kind in ("timespan", "time"):
        if is_span(t):
            return x
        if is_number(t):
            return micros_span((x.cast("double") * 86_400_000_000).cast("long"))
        m = r"^(-?)(?:(\d+)\.)?(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,7}))?)?$"
        part = lambda k: F.regexp_extract(x, m, k)
        number = lambda k: F.coalesce(F.nullif(part(k), F.lit("")).cast("long"), F.lit(0).cast("long"))
        us = ((number(2) * 24 + number(3)) * 60 + number(4)) * 60_000_000 + number(5) * 1_000_000 + F.rpad(part(6), 6, "0").substr(1, 6).try_cast("long")
        clock = F.when(x.rlike(m), F.when(part(1) == "-", -us).otherwise(us))
        unit = r"^(-?\d+(?:\.\d+)?)(d|h|m|s|ms)$"
        scale = F.element_at(F.create_map(*[F.lit(v) for p in (("d", 86400e6), ("h", 3600e6), ("m", 60e6), ("s", 1e6), ("ms", 1e3)) for v in p]), F.regexp_extract(x, unit, 2))
        short = F.when(x.rlike(unit), (F.regexp_extract(x, unit, 1).try_cast("double") * scale).cast("long"))
        days = F.when(x.rlike(r"^-?\d+$"), x.try_cast("long") * 86_400_000_000)
        return micros_span(F.coalesce(clock, short, days))
    if kind == "guid":
        return F.when(x.rlike(r"(?i)^\{?[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}\}?$"), F.lower(F.regexp_replace(F.regexp_replace(x, r"[{}-]", ""), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")))
    return text(x, t)
