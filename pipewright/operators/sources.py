"""Operators that start a pipeline: print, range, and those that end one without changing rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import QueryError
from pipewright.lang.tree import Named
from pipewright.operators.base import operator
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import Frame, json_alias


@operator("print")
def print_(lowering, _frame, op, env):
    one = Frame(lowering.spark.range(1).select(F.lit(0).alias("__pw_one")))
    scope = Scope(lowering, one, env)
    out = []
    for k, e in enumerate(op.exprs):
        v = scope.lower(e)
        name = e.names[0] if isinstance(e, Named) else f"print_{k}"
        out.append(json_alias(v.col, name) if v.json else v.col.alias(name))
    return Frame(scope.frame.df.select(*out))


@operator("range")
def range_(lowering, _frame, op, env):
    """End-inclusive; numbers come from a distributed range, datetimes from the same range times the step."""
    spark = lowering.spark
    scope = Scope(lowering, Frame(spark.range(1)), env)
    a, b, step = (scope.lower(x) for x in (op.start, op.stop, op.step))
    if K.is_time(a.type) or K.is_span(a.type):
        first, last = (K.micros(a.t), K.micros(b.t)) if K.is_time(a.type) else (K.span_micros(a.col), K.span_micros(b.col))
        lo, hi, s = spark.range(1).select(first, last, K.span_micros(step.span)).first()
        made = K.from_micros if K.is_time(a.type) else K.micros_span
        n = (hi - lo) // s + 1 if s and (hi - lo) * s >= 0 else 0
        return Frame(spark.range(max(n, 0)).select(made(F.lit(lo) + F.col("id") * s).alias(op.name)), order=((op.name, s > 0, True),))
    lo, hi, s = (scope.constant(x) for x in (op.start, op.stop, op.step))
    if not s:
        raise QueryError("range: the step is 0")
    whole = all(isinstance(x, int) for x in (lo, hi, s))
    n = (hi - lo) // s + 1 if whole else int((hi - lo) / s + 1e-9) + 1 if (hi - lo) * s >= 0 else 0
    c = F.lit(lo) + F.col("id") * F.lit(s)
    kind = "int" if isinstance(a.type, T.IntegerType) and whole else "long" if whole else "double"
    return Frame(spark.range(max(n, 0)).select(c.cast(kind).alias(op.name)), order=((op.name, s > 0, True),))


@operator("getschema")
def getschema(lowering, frame, _op, _env):
    rows = []
    for k, name in enumerate(frame.columns):
        kind = K.name_of(frame.fields[name].dataType, frame.is_json(name))
        rows.append((name, k, K.clr_name(kind), kind))
    return Frame(lowering.spark.createDataFrame(rows, "ColumnName string, ColumnOrdinal int, DataType string, ColumnType string"))


@operator("consume")
def consume(_lowering, frame, _op, _env):
    return frame


@dataclass(frozen=True)
class RenderInfo:
    """What ``render`` says about a chart; the rows are not changed."""

    kind: str
    title: str | None = None
    x_column: str | None = None
    y_columns: tuple[str, ...] = ()
    series: tuple[str, ...] = ()
    anomaly_columns: tuple[str, ...] = ()
    x_title: str | None = None
    y_title: str | None = None
    x_axis: str | None = None
    y_axis: str | None = None
    y_split: str | None = None
    y_min: float | None = None
    y_max: float | None = None
    x_min: str | None = None
    x_max: str | None = None
    legend: str | None = None
    accumulate: bool = False
    variant: str | None = None
    sorted: bool = False
    extra: dict[str, str] = field(default_factory=dict)


def _names(text: str) -> tuple[str, ...]:
    return tuple(x.strip() for x in text.split(",") if x.strip())


@operator("render")
def render(lowering, frame, op, _env):
    o = {k.lower(): v for k, v in op.options.items()}
    number = lambda k: float(o[k]) if k in o else None
    known = {"title", "xcolumn", "ycolumns", "series", "anomalycolumns", "xtitle", "ytitle", "xaxis", "yaxis", "ysplit", "ymin", "ymax", "xmin", "xmax", "legend", "accumulate", "kind"}
    lowering.render = RenderInfo(
        op.chart, o.get("title"), o.get("xcolumn"), _names(o.get("ycolumns", "")), _names(o.get("series", "")), _names(o.get("anomalycolumns", "")), o.get("xtitle"), o.get("ytitle"), o.get("xaxis"), o.get("yaxis"), o.get("ysplit"),
        number("ymin"), number("ymax"), o.get("xmin"), o.get("xmax"), o.get("legend"), o.get("accumulate", "").lower() == "true", o.get("kind"), bool(frame.order), {k: v for k, v in o.items() if k not in known},
    )
    return frame


@operator("as")
def as_(lowering, frame, op, env):
    lowering.named[op.name] = frame
    env.pop(op.name, None)
    return frame


@operator("invoke")
def invoke(lowering, frame, op, env):
    call = op.call
    return lowering.call(call.name if hasattr(call, "name") else call.id, getattr(call, "args", []), env, frame)


