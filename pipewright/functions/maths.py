"""Numbers, bits, conditions and types."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions.base import MISSING, QueryError, Val, common, function


def _unary(names: str, f) -> None:
    function(names, 1)(lambda _, x: f(x.real))


for _names, _f in {"sqrt": F.sqrt, "exp": F.exp, "cos": F.cos, "sin": F.sin, "tan": F.tan, "acos": F.acos, "asin": F.asin, "atan": F.atan, "degrees": F.degrees, "radians": F.radians, "cot": F.cot}.items():
    _unary(_names, _f)
_unary("exp2", lambda x: F.pow(F.lit(2.0), x))
_unary("exp10", lambda x: F.pow(F.lit(10.0), x))


def _logarithm(f):
    # Spark gives null for 0 and below; here it is -inf and NaN.
    return lambda x: F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(f(x))


_unary("log", _logarithm(F.ln))
_unary("log10", _logarithm(F.log10))
_unary("log2", _logarithm(F.log2))


@function("pow power", 2)
def _pow(_, x, y):
    return F.pow(x.real, y.real)


@function("atan2", 2)
def _atan2(_, y, x):
    return F.atan2(y.real, x.real)


@function("pi", 0)
def _pi(_):
    return F.pi()


def _whole(x: Val, f):
    if K.is_integral(x.type):
        return x.col
    return f(x.real).cast("double")


@function("ceiling ceil", 1)
def _ceiling(_, x):
    return _whole(x, F.ceil)


@function("abs", 1)
def _abs(_, x):
    if K.is_span(x.type):
        return F.when(K.span_micros(x.col) < 0, -x.col).otherwise(x.col)
    return F.abs(x.num)


@function("sign", 1)
def _sign(_, x):
    return F.signum(x.real).cast("long")


@function("dcount_hll", 1)
def _dcount_hll(_, h):
    """The number of different values that a sketch of ``hll`` or ``hll_merge`` has seen."""
    return F.hll_sketch_estimate(h.col)


@function("rand", 0, 1)
def _rand(_, n=None):
    return F.rand() if n is None or n.value in (0, 1) else F.floor(F.rand() * n.real).cast("long")


@function("round", 1, 2)
def _round(_, x, n=None):
    return F.round(x.num, int(n.const("the precision")) if n is not None else 0)


def _numeric_bin(v: Val, size: Val, fixed=None):
    x, s = v.num, size.num
    base = F.lit(0) if fixed is None else fixed.num
    if K.is_integral(v.type) and K.is_integral(size.type) and (fixed is None or K.is_integral(fixed.type)):
        step = F.nullif(s, F.lit(0))
        return (x - base - F.pmod(x - base, step) + base).cast(v.type)
    return F.when(s.cast("double") != 0, F.floor((x - base).cast("double") / s.cast("double")) * s.cast("double") + base)


def _bin(v: Val, size: Val, fixed: Val | None = None):
    """Numbers: the multiple of ``size`` at or below; datetimes: counted from 0001-01-01, or from ``fixed``."""
    if K.is_time(v.type):
        us = size.value if size.is_const and K.is_span(size.type) else None
        s = F.lit(us).cast("long") if us is not None else (K.span_micros(size.span) if K.is_span(size.type) or size.is_string else (size.num.cast("double") * 86_400_000_000).cast("long"))
        origin = F.lit(-K.EPOCH) if fixed is None else K.micros(fixed.t)
        m = K.micros(v.t) - origin
        return K.from_micros(m - F.pmod(m, F.nullif(s, F.lit(0).cast("long"))) + origin)
    if K.is_span(v.type):
        m = K.span_micros(v.col) - (F.lit(0).cast("long") if fixed is None else K.span_micros(fixed.span))
        return K.micros_span(m - F.pmod(m, F.nullif(K.span_micros(size.span), F.lit(0).cast("long"))) + (F.lit(0).cast("long") if fixed is None else K.span_micros(fixed.span)))
    return _numeric_bin(v, size, fixed)


@function("bin", 2)
def _bin_f(_, v, size):
    return _bin(v, size)


@function("floor", 1, 2)
def _floor(_, x, size=None):
    return _bin(x, size) if size is not None else _whole(x, F.floor)


@function("bin_at", 3)
def _bin_at(_, v, size, fixed):
    return _bin(v, size, fixed)


@function("binary_and", 2)
def _binary_and(_, a, b):
    return a.long.bitwiseAND(b.long)


@function("binary_or", 2)
def _binary_or(_, a, b):
    return a.long.bitwiseOR(b.long)


@function("binary_xor", 2)
def _binary_xor(_, a, b):
    return a.long.bitwiseXOR(b.long)


@function("binary_not", 1)
def _binary_not(_, a):
    return F.bitwise_not(a.long)


@function("binary_shift_left", 2)
def _shift_left(_, a, n):
    return F.call_function("shiftleft", a.long, n.int)


@function("binary_shift_right", 2)
def _shift_right(_, a, n):
    return F.call_function("shiftright", a.long, n.int)


@function("bitset_count_ones", 1)
def _count_ones(_, n):
    return F.bit_count(n.long).cast("long")


def _vectorised(f):
    """An Arrow-batched function: the engine has no built-in for it."""

    def one(x: float) -> float:
        try:
            return f(x)
        except (ValueError, OverflowError):
            return float("inf") if x == x and x > 0 else float("nan")

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return x.map(one, na_action="ignore")

    return run


@function("gamma", 1)
def _gamma(_, x):
    return _vectorised(math.gamma)(x.real)


@function("loggamma", 1)
def _loggamma(_, x):
    return _vectorised(math.lgamma)(x.real)


# Nulls and conditions.
@function("isnull", 1)
def _isnull(_, x):
    return x.col.isNull()


@function("isnotnull notnull", 1)
def _isnotnull(_, x):
    return x.col.isNotNull()


@function("isempty", 1)
def _isempty(_, x):
    return x.col.isNull() | (x.s == "") if not isinstance(x.type, T.NullType) else F.lit(True)


@function("isnotempty notempty", 1)
def _isnotempty(_, x):
    return x.col.isNotNull() & (x.s != "")


@function("not", 1)
def _not(_, x):
    return ~x.bool


@function("coalesce", 1, None)
def _coalesce(_, *xs):
    return F.coalesce(*common(list(xs)))


@function("min_of", 1, None)
def _min_of(_, *xs):
    return F.least(*common(list(xs))) if len(xs) > 1 else xs[0]


@function("max_of", 1, None)
def _max_of(_, *xs):
    return F.greatest(*common(list(xs))) if len(xs) > 1 else xs[0]


@function("iff iif", 3)
def _iff(frame, c, a, b):
    x, y = common([a, b])
    return Val(F.when(c.bool, x).otherwise(y), frame, json=a.json and b.json)


@function("case", 3, None)
def _case(_, *xs):
    if len(xs) % 2 == 0:
        raise QueryError("case takes pairs of a condition and a value, and a last value")
    values = common([*xs[1:-1:2], xs[-1]])
    out = None
    for c, v in zip(xs[0:-1:2], values, strict=False):
        out = F.when(c.bool, v) if out is None else out.when(c.bool, v)
    return out.otherwise(values[-1])


@function("gettype", 1)
def _gettype(_, x):
    if x.json:
        first = F.substring(F.ltrim(x.col), 1, 1)
        return F.when(x.col.isNull(), "null").when(first == "{", "dictionary").when(first == "[", "array").when(x.col.isin("true", "false"), "bool").when(x.col.rlike(r"^-?\d+$"), "long").when(x.col.try_cast("double").isNotNull(), "real").otherwise("string")
    kind = "array" if x.is_array else "null" if isinstance(x.type, T.NullType) else K.name_of(x.type)
    return F.when(x.col.isNull(), "null").otherwise(kind) if kind not in ("string", "null") else F.lit(kind)


@function("typeof", 1)
def _typeof(_, x):
    return F.typeof(x.col)


@function("isnan", 1)
def _isnan(_, x):
    return F.isnan(x.real)


@function("isinf", 1)
def _isinf(_, x):
    return F.abs(x.real) == float("inf")


@function("isfinite", 1)
def _isfinite(_, x):
    return ~F.isnan(x.real) & (F.abs(x.real) != float("inf"))


def _conversion(names: str, kind: str) -> None:
    @function(names, 1, 2)
    def convert(frame, x, *_rest):
        if kind in ("real", "int", "long") and x.is_const and x.value is None:
            return Val(F.lit(None).cast(K.SPARK[kind]), frame, K.SPARK[kind], value=None)
        if kind in ("int", "long") and x.whole is not None:
            return Val(x.long if kind == "long" else x.int, frame, K.SPARK[kind])
        return Val(K.cast(x.col, x.type, kind), frame, K.SPARK[kind], value=x.value if x.is_const and kind == "string" and isinstance(x.value, str) else MISSING)


for _names, _kind in {"tostring string": "string", "tobool toboolean bool boolean": "bool", "toint int": "int", "tolong long": "long", "toreal todouble tofloat real double float": "real", "todecimal decimal": "decimal", "todatetime": "datetime", "totimespan": "timespan", "toguid": "guid"}.items():
    _conversion(_names, _kind)
