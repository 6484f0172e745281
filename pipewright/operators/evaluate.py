"""evaluate: pivot, narrow and bag_unpack, whose columns depend on the data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import QueryError
from pipewright.lang.tree import Call, Name, Named
from pipewright.operators.base import operator
from pipewright.plans import naming
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import Frame, fresh, quoted

#: Most columns that a plug-in may make; more values are an error, not a silent cut.
MOST_COLUMNS = 10_000


def _values(df, c, declared):
    if declared is not None:
        return declared
    rows = df.select(c.alias("v")).where(F.col("v").isNotNull()).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise QueryError(f"more than {MOST_COLUMNS} columns")
    return sorted((r["v"] for r in rows), key=str)


def pivot(lowering, frame, call, schema, env):
    """``pivot(column, aggregate, keys…)``; without an aggregate rows are counted.  Declared columns save the pass
    that finds the values."""
    scope = Scope(lowering, frame, env)
    args = list(call.args)
    column = args.pop(0)
    if not isinstance(column, Name):
        raise QueryError("pivot: the first argument is a column")
    agg = args.pop(0) if args and isinstance(args[0], Call) else Call("count", [])
    used = {column.id} | set(_columns_of(agg))
    keys = [a.id for a in args] if args else [c for c in frame.columns if c not in used]
    declared = [n for n, _ in schema if n not in keys and n != "*"] if schema else None
    values = _values(frame.df, quoted(column.id), declared)
    agg_scope = Scope(lowering, scope.frame, env, aggregating=True)
    measure = agg_scope.lower(agg)
    out = agg_scope.frame.df.groupBy(*[quoted(k) for k in keys]).pivot(column.id, values).agg(measure.col)
    cols = [quoted(k) for k in keys]
    count = agg.name in ("count", "countif", "sum", "dcount")
    for v, made in zip(values, out.columns[len(keys) :], strict=True):
        c = quoted(made)
        if count and K.is_number(out.schema[made].dataType):
            c = F.coalesce(c, F.lit(0).cast(out.schema[made].dataType))
        cols.append(c.alias(_label(v)))
    return Frame(out.select(*cols))


def _label(v) -> str:
    return v if isinstance(v, str) else ("True" if v is True else "False" if v is False else str(v))


def _columns_of(e) -> list[str]:
    if isinstance(e, Name):
        return [e.id]
    if isinstance(e, Call):
        return [c for a in e.args for c in _columns_of(a)]
    return [c for a in (getattr(e, "left", None), getattr(e, "right", None), getattr(e, "x", None), getattr(e, "base", None)) if a is not None for c in _columns_of(a)]


def narrow(_lowering, frame, _call, _schema, _env):
    """One row for each cell: Row, Column and Value as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("Column"), K.text(quoted(c), frame.fields[c].dataType).alias("Value")) for c in frame.columns])
    return Frame(frame.df.select(F.explode(cells).alias("__pw_c")).select("__pw_c.Column", "__pw_c.Value"))


def bag_unpack(lowering, frame, call, schema, env):
    """A column for each key that any row's bag has, found in one pass over the keys (none if they are declared)."""
    column = call.args[0]
    if not isinstance(column, Name):
        raise QueryError("bag_unpack: the first argument is a column")
    scope = Scope(lowering, frame, env)
    options = {a.names[0]: a.expr for a in call.args[1:] if isinstance(a, Named)}
    plain = [a for a in call.args[1:] if not isinstance(a, Named)]
    prefix = scope.constant(plain[0]) if plain else ""
    if "OutputColumnPrefix" in options:
        prefix = scope.constant(options["OutputColumnPrefix"])
    bag = scope.lower(column).json_text
    others = [c for c in frame.columns if c != column.id]
    declared = [n for n, _ in schema if n != "*" and n not in others] if schema else None
    if declared is not None:
        keys = [n[len(prefix) :] for n in declared]
    else:
        keys = _values(frame.df.select(F.explode(F.json_object_keys(bag)).alias("k")), quoted("k"), None)
    parsed = fresh("bag")
    df = frame.df.withColumn(parsed, F.from_json(bag, "map<string,string>"))
    kinds = dict(schema) if schema else {}
    namer = naming.Namer(others)
    cols = [quoted(c) for c in others]
    for k in keys:
        name = prefix + k
        c = F.try_element_at(quoted(parsed), F.lit(k))
        cols.append((K.cast(c, T.StringType(), kinds[name]) if kinds.get(name, "string") not in ("string", "dynamic") else c).alias(namer.free(name)))
    return Frame(df.select(*cols))


_PLUGINS = {"pivot": pivot, "narrow": narrow, "bag_unpack": bag_unpack}


@operator("evaluate")
def evaluate(lowering, frame, op, env):
    if not isinstance(op.call, Call) or op.call.name not in _PLUGINS:
        raise QueryError(f"no plug-in {getattr(op.call, 'name', '?')!r}")
    return _PLUGINS[op.call.name](lowering, frame, op.call, op.schema, env)
