"""Series: arrays of numbers on a common axis."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.functions.base import Val, bound, function


def _missing(x: Column, marker: Val | None) -> Column:
    return x.isNull() if marker is None or marker.is_const and marker.value is None else x.isNull() | (x == marker.real)


def _typed(s: Val) -> Column:
    """The series with its own element type if that is a number, else doubles."""
    return s.col if s.is_array and isinstance(s.type.elementType, T.NumericType) else s.reals


def _forward(x: Column, marker: Val | None) -> Column:
    # Each value that is there is repeated up to the next one; before the first stands the head.
    there = lambda x: F.filter(F.transform(x, lambda e, i: F.when(~F.coalesce(_missing(e, marker), F.lit(False)), i)), lambda i: i.isNotNull())
    both = bound(x, lambda x: F.struct(x.alias("x"), there(x).alias("at")))

    def filled(z: Column) -> Column:
        end = F.size(z["x"])
        runs = F.transform(z["at"], lambda i, k: F.array_repeat(F.get(z["x"], i), F.coalesce(F.get(z["at"], k + 1), end) - i))
        return F.concat(F.array_repeat(F.get(z["x"], 0), F.coalesce(F.get(z["at"], 0), end)), F.flatten(runs))

    return F.when(x.isNotNull(), bound(both, filled))


@function("series_fill_forward", 1, 2)
def _fill_forward(_, s, marker=None):
    return _forward(_typed(s), marker)


@function("series_fill_backward", 1, 2)
def _fill_backward(_, s, marker=None):
    return F.reverse(_forward(F.reverse(_typed(s)), marker))


@function("series_fill_const", 2, 3)
def _fill_const(_, s, c, marker=None):
    return F.transform(_typed(s), lambda e: F.when(_missing(e, marker), c.num).otherwise(e))


def _per_series(f, out: str = "array<double>"):
    """An Arrow-batched function of whole series, for what lambdas over arrays cannot say."""

    @F.pandas_udf(out)
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else f(*row) for row in zip(*columns, strict=True)], dtype=object)

    return run


def _numbers(v) -> np.ndarray:
    return np.array([np.nan if x is None else x for x in v], dtype=np.float64)


def _interpolate(v) -> list:
    x = _numbers(v)
    there = np.flatnonzero(~np.isnan(x))
    if not len(there):
        return list(v)
    return np.interp(np.arange(len(x)), there, x[there]).tolist()


@function("series_fill_linear", 1, 4)
def _fill_linear(_, s, *_rest):
    return _per_series(_interpolate)(s.reals)


def _pairwise(name: str, f) -> None:
    @function(name, 2)
    def build(_, a, b):
        x, y = a.reals, b.reals if b.is_array or b.json else None
        if y is None:
            return F.transform(x, lambda e: f(e, b.real))
        n = F.least(F.size(x), F.size(y))
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), f)


_pairwise("series_add", lambda x, y: x + y)
_pairwise("series_subtract", lambda x, y: x - y)
_pairwise("series_multiply", lambda x, y: x * y)
_pairwise("series_divide", lambda x, y: F.when(y == 0, float("nan")).otherwise(x / F.nullif(y, F.lit(0.0))))
_pairwise("series_greater", lambda x, y: x > y)
_pairwise("series_less", lambda x, y: x < y)
_pairwise("series_equals", lambda x, y: x == y)
_pairwise("series_not_equals", lambda x, y: x != y)
_pairwise("series_greater_equals", lambda x, y: x >= y)
_pairwise("series_less_equals", lambda x, y: x <= y)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, e: acc + F.coalesce(e, F.lit(0.0)))


@function("series_fir", 2, 4)
def _fir(_, s, kernel, normalize=None, center=None):
    weight = _total(kernel.reals) if normalize is None or normalize.value is not False else F.lit(1.0)
    parts = F.struct(s.reals.alias("x"), kernel.reals.alias("w"), F.when(weight == 0, 1.0).otherwise(weight).alias("weight"))

    def filtered(z: Column) -> Column:
        at = lambda i: F.aggregate(F.transform(z["w"], lambda c, k: c * F.coalesce(F.when(i - k >= 0, F.get(z["x"], i - k)), F.lit(0.0))), F.lit(0.0), lambda acc, e: acc + e)
        return F.transform(z["x"], lambda _e, i: at(i) / z["weight"])

    return bound(parts, filtered)


def _iir_one(x, b, a) -> list:
    x, b, a = _numbers(x), _numbers(b), _numbers(a)
    out = np.zeros(len(x))
    for n in range(len(x)):
        total = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k)
        total -= sum(a[k] * out[n - k] for k in range(1, len(a)) if n >= k)
        out[n] = total / a[0]
    return out.tolist()


@function("series_iir", 3)
def _iir(_, s, b, a):
    return _per_series(_iir_one)(s.reals, b.reals, a.reals)


def _squares(x: Column) -> Column:
    """The sum of squared deviations from the mean in one pass, with the running mean that DuckDB has."""

    def step(acc: Column, e: Column) -> Column:
        n = acc["n"] + F.lit(1.0)
        mean = acc["mean"] + (e - acc["mean"]) / F.nullif(n, F.lit(0.0))
        return F.struct(n.alias("n"), mean.alias("mean"), (acc["squares"] + (e - mean) * (e - acc["mean"])).alias("squares"))

    return F.aggregate(x, F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "squares")]), step, lambda acc: acc["squares"])


@function("series_stats series_stats_dynamic", 1, 2)
def _stats(frame, s, *_rest):
    # What is used more than once is bound first: inside a lambda it would be made anew for each element.
    first = bound(s.reals, lambda x: F.struct(x.alias("x"), F.filter(x, lambda e: e.isNotNull()).alias("real")))
    second = bound(first, lambda z: F.struct(z["x"].alias("x"), F.size(z["real"]).alias("n"), _total(z["real"]).alias("sum"), F.array_min(z["real"]).alias("low"), F.array_max(z["real"]).alias("high"), _squares(z["real"]).alias("squares")))

    def stats(z: Column) -> Column:
        variance = F.when(z["n"] > 1, z["squares"] / (z["n"] - 1)).when(z["n"] == 1, 0.0)
        return F.struct(z["low"].alias("min"), (F.array_position(z["x"], z["low"]) - 1).alias("min_idx"), z["high"].alias("max"), (F.array_position(z["x"], z["high"]) - 1).alias("max_idx"), (z["sum"] / F.nullif(z["n"], F.lit(0))).alias("avg"), z["sum"].alias("sum"), F.sqrt(variance).alias("stdev"), variance.alias("variance"), F.size(z["x"]).alias("len"))

    return Val(F.to_json(bound(second, stats)), frame, json=True)


@function("series_fit_line series_fit_line_dynamic", 1)
def _fit_line(frame, s):
    n = F.size(s.reals).cast("double")

    def slope(z: Column) -> Column:
        y, n = z["y"], z["n"]
        sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
        sy, sxy = _total(y), _total(F.transform(y, lambda e, i: e * i))
        k = F.when(n > 1, (n * sxy - sx * sy) / F.nullif(n * sxx - sx * sx, F.lit(0.0))).otherwise(0.0)
        return F.struct(y.alias("y"), n.alias("n"), k.alias("slope"), ((sy - k * sx) / F.nullif(n, F.lit(0.0))).alias("start"), (_total(F.transform(y, lambda e: e * e)) - sy * sy / F.nullif(n, F.lit(0.0))).alias("spread"))

    def line(z: Column) -> Column:
        at = lambda i: z["start"] + z["slope"] * i
        left = _total(F.transform(z["y"], lambda e, i: (e - at(i)) * (e - at(i))))
        r2 = F.when(z["spread"] == 0, 1.0).otherwise(1 - left / F.nullif(z["spread"], F.lit(0.0)))
        return F.struct(z["slope"].alias("slope"), z["start"].alias("interception"), r2.alias("rsquare"), F.transform(z["y"], lambda _e, i: at(i)).alias("line_fit"))

    return Val(F.to_json(bound(bound(F.struct(s.reals.alias("y"), n.alias("n")), slope), line)), frame, json=True)


@function("series_pearson_correlation", 2)
def _pearson(_, a, b):
    n = F.size(a.reals).cast("double")
    means = F.struct(a.reals.alias("x"), b.reals.alias("y"), (_total(a.reals) / n).alias("mx"), (_total(b.reals) / n).alias("my"))

    def correlation(z: Column) -> Column:
        x, y, mx, my = z["x"], z["y"], z["mx"], z["my"]
        cov = _total(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my)))
        vx, vy = _total(F.transform(x, lambda p: (p - mx) * (p - mx))), _total(F.transform(y, lambda q: (q - my) * (q - my)))
        return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))

    return bound(means, correlation)


@function("series_outliers", 1, 5)
def _outliers(_, s, *_rest):
    """z-scores: deviations from the mean in sample standard deviations."""
    n = F.size(F.filter(s.reals, lambda e: e.isNotNull()))
    first = F.struct(s.reals.alias("x"), n.alias("n"), (_total(s.reals) / F.nullif(n, F.lit(0))).alias("mean"))
    square = lambda z: F.aggregate(z["x"], F.lit(0.0), lambda acc, e: acc + F.coalesce((e - z["mean"]) * (e - z["mean"]), F.lit(0.0)))
    second = bound(first, lambda z: F.struct(z["x"].alias("x"), z["mean"].alias("mean"), F.sqrt(square(z) / F.nullif(z["n"] - 1, F.lit(0))).alias("spread")))
    return bound(second, lambda z: F.transform(z["x"], lambda e: F.when(z["spread"] > 0, (e - z["mean"]) / F.nullif(z["spread"], F.lit(0.0))).otherwise(0.0)))


def _score(x: np.ndarray, period: int) -> float:
    if period < 1 or period >= len(x):
        return 0.0
    a, b = x[:-period], x[period:]
    va, vb = a - a.mean(), b - b.mean()
    d = np.sqrt((va * va).sum() * (vb * vb).sum())
    return float(max(0.0, (va * vb).sum() / d)) if d > 0 else 0.0


def _detect(x, low, high, count) -> str:
    import json

    x = np.nan_to_num(_numbers(x))
    scores = sorted(((_score(x, p), p) for p in range(max(1, int(low)), min(int(high), len(x) - 2) + 1)), key=lambda t: (-t[0], t[1]))
    best: list[tuple[float, int]] = []
    for score, p in scores:
        # A multiple of a period that is already there says nothing new.
        if score > 0 and all(p % q for _, q in best):
            best.append((score, p))
        if len(best) == int(count):
            break
    return json.dumps({"periods": [p for _, p in best], "scores": [round(s, 6) for s, _ in best]})


@function("series_periods_detect", 4)
def _periods_detect(frame, s, low, high, n):
    """The periods between two lengths that correlate best with the series itself, with their scores."""
    return Val(_per_series(_detect, "string")(s.reals, low.real, high.real, n.real), frame, json=True)


@function("series_periods_validate", 2, None)
def _periods_validate(_, s, *periods):
    f = _per_series(lambda x, p: [_score(np.nan_to_num(_numbers(x)), int(round(q))) for q in p])
    return f(s.reals, F.array(*[p.real for p in periods]))
