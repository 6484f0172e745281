"""top-nested and top-hitters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pipewright.functions import Val
from pipewright.lang.tree import Call, Named
from pipewright.operators.base import operator
from pipewright.plans import naming
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import Frame, fresh, quoted


@operator("top-nested")
def top_nested(lowering, frame, op, env):
    """Level by level: values of the level are aggregated per kept parent, ranked, and cut.

    Every level aggregates the rows of the kept parents only (a join with a table of at most as many rows as the
    parents' limits allow).  Ties are broken by the value itself.
    """
    namer = naming.Namer()
    rows = frame.df
    kept = None
    parents: list[str] = []
    result: list[str] = []
    for n, e, others, by, ascending in op.levels:
        inner = e.expr if isinstance(e, Named) else e
        scope = Scope(lowering, Frame(rows), env)
        value = scope.lower(inner)
        column = namer.free(e.names[0] if isinstance(e, Named) else naming.of_key(inner))
        agg = by.expr if isinstance(by, Named) else by
        label = namer.free(by.names[0] if isinstance(by, Named) else f"aggregated_{column}")
        hidden = fresh("l")
        rows = scope.frame.df.withColumn(hidden, value.col)
        inputs = rows if kept is None else rows.join(kept.select(*[quoted(p).alias(p + "_k") for p in parents]), [quoted(p).eqNullSafe(quoted(p + "_k")) for p in parents], "left_semi")
        scope = Scope(lowering, Frame(inputs), env, aggregating=True)
        measured = scope.lower(agg)
        grouped = scope.frame.df.groupBy(*[quoted(p) for p in parents], quoted(hidden)).agg(measured.col.alias(label))
        if n is not None:
            limit = int(Scope(lowering, frame, env).constant(n))
            order = quoted(label).asc_nulls_last() if ascending else quoted(label).desc_nulls_last()
            rank = fresh("rank")
            ranked = grouped.withColumn(rank, F.row_number().over(Window.partitionBy(*[quoted(p) for p in parents]).orderBy(order, quoted(hidden).asc_nulls_last())))
            level = ranked.where(F.col(rank) <= limit).drop(rank)
            if others is not None:
                # Everything beyond the limit is one more value, aggregated from its rows.
                label_other = Scope(lowering, frame, env).lower(others)
                tail = ranked.where(F.col(rank) > limit).select(*[quoted(p) for p in parents], quoted(hidden))
                condition = [quoted(c).eqNullSafe(quoted(c + "_t")) for c in [*parents, hidden]]
                left = inputs.join(tail.select(*[quoted(c).alias(c + "_t") for c in [*parents, hidden]]), condition, "left_semi")
                other_scope = Scope(lowering, Frame(left), env, aggregating=True)
                m = other_scope.lower(agg)
                rest = other_scope.frame.df.groupBy(*[quoted(p) for p in parents]).agg(m.col.alias(label), F.count(F.lit(1)).alias("__pw_n")).where("__pw_n > 0")
                level = level.unionByName(rest.select(*[quoted(p) for p in parents], label_other.col.cast(grouped.schema[hidden].dataType).alias(hidden), quoted(label)))
        else:
            level = grouped
        if kept is None:
            kept = level
        else:
            right = level.select(*[quoted(p).alias(p + "_r") for p in parents], quoted(hidden), quoted(label))
            kept = kept.join(right, [quoted(p).eqNullSafe(quoted(p + "_r")) for p in parents]).drop(*[p + "_r" for p in parents])
        parents = [*parents, hidden]
        result += [(hidden, column), (label, label)]
    return Frame(kept.select(*[quoted(h).alias(n) for h, n in result]))


@operator("top-hitters")
def top_hitters(lowering, frame, op, env):
    """The heaviest values, counted exactly, in ascending order of weight."""
    scope = Scope(lowering, frame, env)
    inner = op.expr.expr if isinstance(op.expr, Named) else op.expr
    v = scope.lower(inner)
    name = op.expr.names[0] if isinstance(op.expr, Named) else naming.of_key(inner) or "Column1"
    agg_scope = Scope(lowering, scope.frame, env, aggregating=True)
    weight: Val = agg_scope.lower(Call("sum", [op.weight]) if op.weight is not None else Call("count", []))
    label = f"approximate_sum_{naming.simple(op.weight) or ''}" if op.weight is not None else f"approximate_count_{name}"
    n = int(scope.constant(op.n))
    hidden = fresh("h")
    grouped = scope.frame.df.groupBy(v.col.alias(hidden)).agg(weight.col.alias(label))
    best = grouped.orderBy(quoted(label).desc_nulls_last(), quoted(hidden).asc_nulls_last()).limit(n)
    out = best.select(quoted(hidden).alias(name), quoted(label)).orderBy(quoted(label).asc_nulls_first(), quoted(name).desc_nulls_first())
    return Frame(out, order=((label, True, True),))
