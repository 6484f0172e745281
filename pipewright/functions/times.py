"""Dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pipewright import types as K
from pipewright.functions.base import QueryError, Val, function

_US = {"microsecond": 1, "millisecond": 1000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def plus_months(t: Column, n: Column) -> Column:
    """Months later, the day cut to the month's end, the time of day kept."""
    day = F.date_trunc("day", t.cast("timestamp")).cast("timestamp_ntz")
    return F.add_months(day.cast("date"), n).cast("timestamp_ntz") + (t - day)


def plus_micros(t: Column, us: Column) -> Column:
    return K.from_micros(K.micros(t) + us)


def trunc(unit: str, t: Column) -> Column:
    return F.date_trunc(unit, t.cast("timestamp")).cast("timestamp_ntz")


def start_of(unit: str, t: Column, n: Column | None = None) -> Column:
    """Weeks start on Sunday."""
    if unit == "week":
        day = F.lit(_US["day"])
        out = plus_micros(trunc("week", plus_micros(t, day)), -day)
        return out if n is None else plus_micros(out, n.cast("long") * _US["week"])
    out = trunc(unit, t)
    if n is None:
        return out
    return plus_micros(out, n.cast("long") * _US["day"]) if unit == "day" else plus_months(out, n * _MONTHS[unit])


for _unit in ("day", "week", "month", "year"):

    @function(f"startof{_unit}", 1, 2)
    def _start(_, t, n=None, unit=_unit):
        return start_of(unit, t.t, None if n is None else n.int)

    @function(f"endof{_unit}", 1, 2)
    def _end(_, t, n=None, unit=_unit):
        later = F.lit(1) if n is None else n.int + 1
        return plus_micros(start_of(unit, t.t, later), F.lit(-1).cast("long"))


@function("now", 0, 1)
def _now(_, offset=None):
    t = F.current_timestamp().cast("timestamp_ntz")
    return t if offset is None else t + offset.span


@function("ago", 1)
def _ago(_, span):
    return F.current_timestamp().cast("timestamp_ntz") - span.span


@function("dayofweek", 1)
def _dayofweek(_, t):
    return K.micros_span((F.dayofweek(t.t) - 1).cast("long") * _US["day"])


for _names, _f in {"dayofmonth": F.dayofmonth, "dayofyear": F.dayofyear, "getmonth monthofyear": F.month, "getyear": F.year, "weekofyear week_of_year": F.weekofyear, "hourofday": F.hour, "minuteofhour": F.minute, "secondofminute": F.second}.items():
    function(_names, 1)(lambda _, t, f=_f: f(t.t))


@function("make_datetime datetime_from_parts", 1, 6)
def _make_datetime(_, y, m=None, d=None, h=None, mi=None, s=None):
    if m is None:
        return y.t
    one, zero = F.lit(1), F.lit(0)
    second = zero.cast("decimal(16,6)") if s is None else s.num.cast("decimal(16,6)")
    return F.try_make_timestamp_ntz(y.int, m.int, one if d is None else d.int, zero if h is None else h.int, zero if mi is None else mi.int, second)


@function("make_timespan", 2, 4)
def _make_timespan(_, a, b, c=None, d=None):
    zero = F.lit(0)
    days, h, m, s = (a.int, b.int, c.int, d.real) if d is not None else (zero, a.int, b.int, c.real if c is not None else zero.cast("double"))
    fine = days.between(0, 10_675_199) & h.between(0, 23) & m.between(0, 59) & (s >= 0) & (s < 60)
    us = days.cast("long") * _US["day"] + h.cast("long") * _US["hour"] + m.cast("long") * _US["minute"] + F.round(s * 1_000_000).cast("long")
    return F.when(fine, K.micros_span(us))


@function("unixtime_seconds_todatetime", 1)
def _from_s(_, n):
    return K.from_micros((n.real * 1_000_000).cast("long") if not K.is_integral(n.type) else n.long * 1_000_000)


@function("unixtime_milliseconds_todatetime", 1)
def _from_ms(_, n):
    return K.from_micros(n.long * 1000)


@function("unixtime_microseconds_todatetime", 1)
def _from_us(_, n):
    return K.from_micros(n.long)


@function("unixtime_nanoseconds_todatetime", 1)
def _from_ns(_, n):
    return K.from_micros(F.call_function("div", n.long, F.lit(1000).cast("long")))


def _unit(x: Val) -> str:
    u = str(x.const("the part")).lower()
    u = {"week_of_year": "week", "weekofyear": "week", "ms": "millisecond", "us": "microsecond"}.get(u, u)
    return u[:-1] if u.endswith("s") and u not in ("s",) else u


@function("datetime_part", 2)
def _datetime_part(_, part, t):
    u = _unit(part)
    x = t.t
    simple = {"year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "day": F.dayofmonth, "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second}
    if u in simple:
        return simple[u](x).cast("long")
    fraction = F.pmod(K.micros(x), F.lit(1_000_000))
    if u in ("millisecond", "microsecond", "nanosecond"):
        return {"millisecond": F.floor(fraction / 1000), "microsecond": fraction, "nanosecond": fraction * 1000}[u].cast("long")
    raise QueryError(f"datetime_part: no part {u!r}")


@function("datetime_add", 3)
def _datetime_add(_, part, n, t):
    u = _unit(part)
    if u in _MONTHS:
        return plus_months(t.t, n.int * _MONTHS[u])
    if u not in _US:
        raise QueryError(f"datetime_add: no part {u!r}")
    return plus_micros(t.t, n.long * _US[u])


@function("datetime_diff", 3)
def _datetime_diff(_, part, a, b):
    """Boundaries of the part between the two, positive if ``a`` is later."""
    u = _unit(part)
    x, y = a.t, b.t
    if u in _MONTHS:
        months = lambda t: F.year(t) * 12 + F.month(t) - 1
        whole = lambda t: F.floor(months(t) / _MONTHS[u])
        return (whole(x) - whole(y)).cast("long")
    us = lambda t: K.micros(t)
    if u in ("nanosecond", "tick"):
        return (us(x) - us(y)) * (1000 if u == "nanosecond" else 10)
    if u == "week":
        # Monday 1969-12-29 starts week 0.
        whole = lambda t: F.floor((us(t) + 3 * _US["day"]) / _US["week"])
    elif u in _US:
        whole = lambda t: us(t) if _US[u] == 1 else (us(t) - F.pmod(us(t), F.lit(_US[u]))) / _US[u]
    else:
        raise QueryError(f"datetime_diff: no part {u!r}")
    return (whole(x) - whole(y)).cast("long")


def _tokens(pattern: str) -> list[tuple[str, int | str]]:
    """(letter, run length) and ("", literal) pieces of a format."""
    out: list[tuple[str, int | str]] = []
    k = 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            out.append(("", pattern[k + 1]))
            k += 2
        elif c in "yMdHhmsfFt":
            n = 1
            while k + n < len(pattern) and pattern[k + n] == c:
                n += 1
            out.append((c, n))
            k += n
        else:
            out.append(("", c))
            k += 1
    return out


@function("format_datetime", 2)
def _format_datetime(_, t, pattern):
    java = ""
    for letter, n in _tokens(pattern.const("the format")):
        if not letter:
            java += "''" if n == "'" else f"'{n}'" if n.isalpha() else n
        elif letter in "fF":
            java += "S" * n
        else:
            java += "a" if letter == "t" else letter * n
    return F.date_format(t.t, java) if java else F.lit("")


@function("format_timespan", 2)
def _format_timespan(_, span, pattern):
    us = F.abs(K.span_micros(span.span))
    field = {"d": F.floor(us / _US["day"]), "h": F.floor(F.pmod(us, F.lit(_US["day"])) / _US["hour"]), "m": F.floor(F.pmod(us, F.lit(_US["hour"])) / _US["minute"]), "s": F.floor(F.pmod(us, F.lit(_US["minute"])) / _US["second"])}
    field["H"] = field["h"]
    fraction = F.concat(F.lpad(F.pmod(us, F.lit(_US["second"])).cast("string"), 6, "0"), F.lit("0"))
    parts = []
    for letter, n in _tokens(pattern.const("the format")):
        if letter in field:
            x = field[letter].cast("string")
            parts.append(F.when(F.char_length(x) < n, F.lpad(x, n, "0")).otherwise(x))
        elif letter == "f":
            parts.append(F.substring(fraction, 1, n))
        elif letter == "F":
            parts.append(F.regexp_replace(F.substring(fraction, 1, n), "0+$", ""))
        else:
            parts.append(F.lit(n if not letter else letter * n))
    return F.concat(*parts)


@function("datetime_local_to_utc", 2)
def _to_utc(_, t, zone):
    return F.to_utc_timestamp(t.t.cast("timestamp"), zone.s).cast("timestamp_ntz")


@function("datetime_utc_to_local", 2)
def _to_local(_, t, zone):
    return F.from_utc_timestamp(t.t.cast("timestamp"), zone.s).cast("timestamp_ntz")
