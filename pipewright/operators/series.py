"""make-series: aggregates on a regular axis, as arrays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import Val
from pipewright.lang.tree import Named
from pipewright.operators.base import operator
from pipewright.operators.summarize import aggregates
from pipewright.operators.tabular import _named
from pipewright.plans import naming
from pipewright.plans.expressions import Scope, compare
from pipewright.plans.frame import Frame, fresh, quoted


def _cell(field: str, gap, kind: str | None):
    """The value at a step, or the default."""

    def at(i):
        value = F.try_element_at(F.col("__pw_m"), i)[field]
        return F.coalesce(value.cast(kind) if kind else value, gap)

    return at


@operator("make-series")
def make_series(lowering, frame, op, env):
    """Rows are aggregated per key and axis step; a second grouping gathers each key's steps into a map that fills a
    dense array.  No grid is materialised or joined: what is shuffled is what the data has, not what the axis has.

    ``to`` is exclusive, ``in range`` inclusive; without limits the axis spans the data.  Gaps get the default, 0.
    """
    scope = Scope(lowering, frame, env)
    axis_e = op.axis.expr if isinstance(op.axis, Named) else op.axis
    axis = scope.lower(axis_e)
    axis_name = op.axis.names[0] if isinstance(op.axis, Named) else naming.of_key(axis_e) or "Column1"
    step = scope.lower(op.step)
    time = K.is_time(axis.type)
    number = (lambda v: K.micros(v.t)) if time else (lambda v: K.span_micros(v.span)) if K.is_span(axis.type) else (lambda v: v.num)
    s = K.span_micros(step.span) if time or K.is_span(axis.type) else step.num
    integral = time or K.is_span(axis.type) or K.is_integral(axis.type) and K.is_integral(step.type)
    x = fresh("x")
    start = scope.lower(op.start) if op.start is not None else None
    stop = scope.lower(op.stop) if op.stop is not None else None
    df = scope.frame.df
    # The limits on the axis itself, where the scan can use them.
    if start is not None:
        df = df.where(compare(">=", axis, start))
    if stop is not None:
        df = df.where(compare("<=" if op.inclusive else "<", axis, stop))
    df = df.withColumn(x, number(axis)).where(F.col(x).isNotNull())
    low = number(start) if start is not None else None
    high = number(stop) if stop is not None else None
    lo, hi = fresh("lo"), fresh("hi")
    if low is None or high is None:
        # The missing limit is the data's; one row, joined in.
        ends = df.agg(F.min(x).alias("__pw_min"), F.max(x).alias("__pw_max"))
        df = df.crossJoin(F.broadcast(ends))
        if time or K.is_span(axis.type):
            origin = F.lit(-K.EPOCH) if time else F.lit(0)
            snapped = F.col("__pw_min") - F.pmod(F.col("__pw_min") - origin, s)
        else:
            snapped = F.floor(F.col("__pw_min") / s) * s
        low_c = low if low is not None else snapped
        high_c = high if high is not None else F.col("__pw_max")
    else:
        low_c, high_c = low, high
    inclusive = op.inclusive or high is None
    df = df.withColumn(lo, low_c).withColumn(hi, high_c)
    inside = (F.col(x) >= F.col(lo)) & ((F.col(x) <= F.col(hi)) if inclusive else (F.col(x) < F.col(hi)))
    df = df.where(inside)
    at = fresh("i")
    df = df.withColumn(at, F.floor((F.col(x) - F.col(lo)) / s).cast("int") if not integral else F.call_function("div", F.col(x) - F.col(lo), s).cast("int"))
    n = (F.call_function("div", F.col(hi) - F.col(lo), s) if integral else F.floor((F.col(hi) - F.col(lo)) / s)).cast("int") + 1
    if not inclusive:
        n = F.ceil((F.col(hi) - F.col(lo)) / s).cast("int")
    rows = scope.frame.with_df(df)
    key_scope = Scope(lowering, rows, env)
    namer = naming.Namer()
    keys = []
    for name, v, _ in _named(key_scope, op.by, namer, naming.of_key):
        hidden = fresh("k")
        key_scope.frame = key_scope.frame.with_df(key_scope.frame.df.withColumn(hidden, v.col))
        keys.append((hidden, name))
    agg_scope = Scope(lowering, key_scope.frame, env, aggregating=True)
    named = aggregates(agg_scope, [e for e, _ in op.aggs], namer)
    group = [quoted(h) for h, _ in keys] + [quoted(k) for k in frame.keys]
    cells = agg_scope.frame.df.groupBy(*group, quoted(at)).agg(*[v.col.alias(f"__pw_v{k}") for k, (_, v) in enumerate(named)], F.first(lo).alias(lo), F.first(hi).alias(hi))
    values = [f"__pw_v{k}" for k in range(len(named))]
    lists = cells.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct(quoted(at).alias("i"), F.struct(*[quoted(v) for v in values]).alias("v")))).alias("__pw_m"), F.first(lo).alias(lo), F.first(hi).alias(hi))
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    out = [quoted(h).alias(name) for h, name in keys]
    for k, ((name, _), (_, default)) in enumerate(zip(named, op.aggs, strict=True)):
        kind = cells.schema[values[k]].dataType
        d: Val | None = scope.lower(default) if default is not None else None
        gap = F.lit(0).cast(kind) if d is None and K.is_number(kind) else F.lit(None).cast(kind) if d is None else d.col.cast(T.DoubleType() if isinstance(d.type, (T.DoubleType, T.DecimalType)) and K.is_number(kind) else kind)
        wide = d is not None and isinstance(d.type, T.DoubleType) and K.is_number(kind)
        out.append(F.transform(steps, _cell(values[k], gap, "double" if wide else None)).alias(name))
    point = lambda i: F.col(lo) + i.cast("long") * s if integral else F.col(lo) + i * s
    made = (lambda i: K.from_micros(point(i))) if time else (lambda i: K.micros_span(point(i))) if K.is_span(axis.type) else (lambda i: point(i).cast(axis.type if integral else "double"))
    out.append(F.transform(steps, made).alias(axis_name))
    return Frame(lists.select(*out, *[quoted(k) for k in frame.keys if k.startswith("__pw")]), (), frame.keys)
