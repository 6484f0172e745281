"""Aggregate functions: builders of aggregate columns, all with map-side partial aggregation where Spark has it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions.base import QueryError, Val, bound

#: name -> builder(scope, *values).  ``scope.hoist`` turns an expression into a column of the input.
AGGREGATES: dict[str, Callable[..., Any]] = {}
#: What an unnamed aggregate's column name starts with, where that is not the function's name.
PREFIX = {"make_list": "list", "makelist": "list", "make_set": "set", "makeset": "set", "make_bag": "bag", "make_list_if": "list", "makelistif": "list", "make_set_if": "set", "makesetif": "set", "make_list_with_nulls": "list", "make_bag_if": "bag"}
#: Aggregates with several result columns, which ``summarize`` expands itself.
WIDE = {"arg_max", "arg_min", "argmax", "argmin", "percentiles", "percentilesw", "take_any", "any"}


def aggregate(names: str) -> Callable:
    def add(f: Callable) -> Callable:
        for n in names.split():
            AGGREGATES[n] = f
        return f

    return add


def _nan_if_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(float("nan")))


def _values(x: Val) -> Column:
    return x.col if K.is_span(x.type) or K.is_number(x.type) else x.num


def _micros(x: Column) -> Column:
    """A timespan's microseconds as a decimal, of which sums do not overflow."""
    return K.span_micros(x).cast("decimal(20,0)")


def _sum(x: Column, v: Val) -> Column | Val:
    if not K.is_span(v.type):
        return F.coalesce(F.sum(x), F.lit(0))
    # A sum that does not fit the timespan is null; its microseconds are kept for what divides it.
    us = F.coalesce(F.sum(_micros(x)), F.lit(0).cast("decimal(30,0)"))
    return Val(K.micros_span(us.try_cast("long")), v.frame, K.SPAN, micros=us)


def _mean_span(x: Column) -> Column:
    return K.micros_span(F.round(F.sum(_micros(x)) / F.nullif(F.count(x), F.lit(0)), 0).cast("long"))


@aggregate("count")
def _count(_, x=None):
    return F.count(F.lit(1) if x is None else x.col)


@aggregate("countif")
def _countif(_, p):
    return F.count_if(p.bool)


@aggregate("sum")
def _sum_all(_, x):
    return _sum(_values(x), x)


@aggregate("sumif")
def _sumif(_, x, p):
    return _sum(F.when(p.bool, _values(x)), x)


@aggregate("avg")
def _avg(_, x):
    return _mean_span(x.col) if K.is_span(x.type) else _nan_if_empty(F.avg(_values(x)))


@aggregate("avgif")
def _avgif(_, x, p):
    return _mean_span(F.when(p.bool, x.col)) if K.is_span(x.type) else _nan_if_empty(F.avg(F.when(p.bool, _values(x))))


@aggregate("min")
def _min(_, x):
    return F.min(x.col)


@aggregate("max")
def _max(_, x):
    return F.max(x.col)


@aggregate("minif")
def _minif(_, x, p):
    return F.min(F.when(p.bool, x.col))


@aggregate("maxif")
def _maxif(_, x, p):
    return F.max(F.when(p.bool, x.col))


for _n, _f in {"stdev": F.stddev_samp, "variance": F.var_samp}.items():
    # A single row has no spread, not an unknown one.
    AGGREGATES[_n] = lambda _, x, f=_f: F.coalesce(f(x.real), F.lit(0.0))
    AGGREGATES[_n + "if"] = lambda _, x, p, f=_f: F.coalesce(f(F.when(p.bool, x.real)), F.lit(0.0))
for _n, _f in {"stdevp": F.stddev_pop, "variancep": F.var_pop}.items():
    AGGREGATES[_n] = lambda _, x, f=_f: f(x.real)
    AGGREGATES[_n + "if"] = lambda _, x, p, f=_f: f(F.when(p.bool, x.real))
for _n, _f in {"covariance": F.covar_samp, "covariancep": F.covar_pop}.items():
    AGGREGATES[_n] = lambda _, x, y, f=_f: f(x.real, y.real)
    AGGREGATES[_n + "if"] = lambda _, x, y, p, f=_f: f(F.when(p.bool, x.real), F.when(p.bool, y.real))
for _n, _f in {"binary_all_and": F.bit_and, "binary_all_or": F.bit_or, "binary_all_xor": F.bit_xor}.items():
    AGGREGATES[_n] = lambda _, x, f=_f: f(x.long)


@aggregate("dcount count_distinct")
def _dcount(_, x, *_accuracy):
    return F.count_distinct(x.col)


@aggregate("dcountif count_distinctif")
def _dcountif(_, x, p, *_accuracy):
    return F.count_distinct(F.when(p.bool, x.col))


@aggregate("hll")
def _hll(_, x, *_accuracy):
    return F.hll_sketch_agg(x.s if not K.is_integral(x.type) else x.long)


@aggregate("hll_if")
def _hll_if(_, x, p, *_accuracy):
    return F.hll_sketch_agg(F.when(p.bool, x.s if not K.is_integral(x.type) else x.long))


@aggregate("hll_merge")
def _hll_merge(_, h):
    return F.hll_union_agg(h.col)


@aggregate("buildschema")
def _buildschema(_, d):
    return F.schema_of_variant_agg(F.try_parse_json(d.json_text)) if d.is_string else F.min(F.typeof(d.col))


def _limited(c: Column, most: Val | None) -> Column:
    return c if most is None else F.slice(c, 1, int(most.const("the maximum size")))


@aggregate("make_list makelist")
def _make_list(_, x, most=None):
    return _limited(F.collect_list(x.col), most)


@aggregate("make_list_if makelistif")
def _make_list_if(_, x, p, most=None):
    return _limited(F.collect_list(F.when(p.bool, x.col)), most)


@aggregate("make_list_with_nulls")
def _make_list_with_nulls(_, x):
    return F.transform(F.collect_list(F.struct(x.col.alias("x"))), lambda s: s["x"])


@aggregate("make_set makeset")
def _make_set(_, x, most=None):
    return _limited(F.array_sort(F.collect_set(x.col)), most)


@aggregate("make_set_if makesetif")
def _make_set_if(_, x, p, most=None):
    return _limited(F.array_sort(F.collect_set(F.when(p.bool, x.col))), most)


def _bag(scope: Any, lists: Column) -> Val:
    """Members of a list of bags; the first that has a key wins."""
    entries = F.flatten(F.transform(lists, lambda b: F.map_entries(F.from_json(b, "map<string,variant>"))))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    first = lambda n: F.get(F.filter(entries, lambda e: e["key"] == n), 0)["value"]
    return Val(F.to_json(F.map_from_arrays(names, F.transform(names, first))), scope.frame, json=True)


@aggregate("make_bag")
def _make_bag(scope, d, *_most):
    return _bag(scope, F.collect_list(d.json_text))


@aggregate("make_bag_if")
def _make_bag_if(scope, d, p, *_most):
    return _bag(scope, F.collect_list(F.when(p.bool, d.json_text)))


@aggregate("any take_any")
def _take_any(_, x):
    return F.any_value(x.col, F.lit(True))


@aggregate("anyif take_anyif")
def _take_anyif(_, x, p):
    return F.any_value(F.when(p.bool, x.col), F.lit(True))


def _percent(p: Val) -> float:
    return float(p.const("the percentile")) / 100


def _restored(c: Column, t: T.DataType) -> Column:
    return K.from_micros(c.cast("long")) if K.is_time(t) else K.micros_span(c.cast("long")) if K.is_span(t) else c.cast(t)


def _orderable(x: Val) -> tuple[Column, T.DataType]:
    """The values as numbers, and the type to give back."""
    if K.is_time(x.type):
        return K.micros(x.t), x.type
    if K.is_span(x.type):
        return K.span_micros(x.col), x.type
    return (x.num, x.type) if K.is_number(x.type) else (x.num, T.DoubleType())


def percentile(scope: Any, x: Val, p: Val) -> Column:
    """The smallest value with at least that share of the values at or below it (nearest rank, no interpolation)."""
    c, t = _orderable(x)
    name = scope.hoist(c)
    return _restored(F.expr(f"percentile_disc({_percent(p)!r}D) WITHIN GROUP (ORDER BY `{name}`)"), t)


@aggregate("percentile")
def _percentile(scope, x, p):
    return percentile(scope, x, p)


def weighted(scope: Any, x: Val, w: Val, p: Val) -> Column:
    """Nearest rank where each value counts ``w`` times.

    The group's (value, weight) pairs are collected and sorted, as a list in one row.
    """
    c, t = _orderable(x)
    pairs = F.array_sort(F.collect_list(F.struct(c.cast("double").alias("x"), F.greatest(w.num.cast("long"), F.lit(0)).alias("w"))))
    pairs = F.filter(pairs, lambda e: e["x"].isNotNull() & (e["w"] > 0))

    def found(z: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("v"))
        step = lambda acc, e: F.struct((acc["n"] + e["w"]).alias("n"), F.when(acc["v"].isNull() & ((acc["n"] + e["w"]).cast("double") >= z["goal"]), e["x"]).otherwise(acc["v"]).alias("v"))
        return F.aggregate(z["pairs"], start, step)["v"]

    # Pairs and goal are bound one after the other: else each step of the sum would make them anew.
    with_goal = bound(pairs, lambda q: F.struct(q.alias("pairs"), (F.aggregate(q, F.lit(0).cast("long"), lambda acc, e: acc + e["w"]).cast("double") * F.lit(_percent(p))).alias("goal")))
    return _restored(bound(with_goal, found), t)


@aggregate("percentilew")
def _percentilew(scope, x, w, p):
    return weighted(scope, x, w, p)


def _shares(ps: tuple[Val, ...]) -> list[Val]:
    if len(ps) == 1 and ps[0].is_const and isinstance(ps[0].value, list):
        return [Val(F.lit(float(v)), ps[0].frame, value=v) for v in ps[0].value]
    return list(ps)


@aggregate("percentiles_array")
def _percentiles_array(scope, x, *ps):
    return F.array(*[percentile(scope, x, p) for p in _shares(ps)])


@aggregate("percentilesw_array")
def _percentilesw_array(scope, x, w, *ps):
    return F.array(*[weighted(scope, x, w, p) for p in _shares(ps)])


@aggregate("percentiles")
def _percentiles(*_):
    raise QueryError("percentiles has several columns; it stands alone in summarize")


@aggregate("arg_max arg_min argmax argmin")
def _arg(scope, k, *vs):
    raise QueryError("arg_max and arg_min have several columns; they stand alone in summarize")
