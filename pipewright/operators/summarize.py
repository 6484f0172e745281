"""summarize: one grouped aggregation, partial on the map side."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright.functions import Val
from pipewright.functions.aggregates import percentile, weighted, _shares
from pipewright.lang.tree import Call, Named, Star
from pipewright.operators.base import operator
from pipewright.operators.tabular import _named
from pipewright.plans import naming
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import MICROS, Frame, fresh, json_alias, quoted


def _extreme(scope, e, names, namer):
    """The columns of arg_max and arg_min: the key's extremum, then values of its row (all columns for ``*``)."""
    rows = scope.rows()
    largest = e.name in ("arg_max", "argmax")
    key = rows.lower(e.args[0])
    best, pick = (F.max, F.max_by) if largest else (F.min, F.min_by)
    names = list(names)
    key_name = names.pop(0) if names else naming.of_expression(e.args[0]) or f"{'max' if largest else 'min'}_"
    out = [(namer.free(key_name), Val(best(key.col), scope.frame, json=key.json))]
    values = []
    for a in e.args[1:]:
        if isinstance(a, Star):
            values += [(c, Val(quoted(c), scope.frame, json=scope.frame.is_json(c))) for c in scope.frame.columns if c != key_name and c not in namer.taken]
        else:
            values.append((naming.of_expression(a), rows.lower(a)))
    if values:
        # One struct for all values: they come from one row, ties included, and nulls are kept.
        row = pick(F.struct(*[v.col.alias(f"v{k}") for k, (_, v) in enumerate(values)]), key.col)
        for k, (n, v) in enumerate(values):
            out.append((namer.free(names[k] if k < len(names) else n), Val(row[f"v{k}"], scope.frame, json=v.json)))
    return out


def aggregates(scope, exprs, namer):
    """(name, aggregate) of each expression of a summarize."""
    out = []
    for e in exprs:
        inner = e.expr if isinstance(e, Named) else e
        names = e.names if isinstance(e, Named) else []
        kind = inner.name if isinstance(inner, Call) else ""
        if kind in ("arg_max", "arg_min", "argmax", "argmin"):
            out += _extreme(scope, inner, names, namer)
        elif kind in ("take_any", "any") and inner.args and isinstance(inner.args[0], Star):
            row = F.first(F.struct(*[quoted(c) for c in scope.frame.columns]))
            out += [(namer.free(c), Val(row[c], scope.frame, json=scope.frame.is_json(c))) for c in scope.frame.columns if c not in namer.taken]
        elif kind in ("take_any", "any") and len(inner.args) > 1:
            out += [(namer.free(naming.simple(a)), scope.lower(Call("take_any", [a]))) for a in inner.args]
        elif kind in ("percentiles", "percentilesw"):
            rows = scope.rows()
            x = rows.lower(inner.args[0])
            w = rows.lower(inner.args[1]) if kind == "percentilesw" else None
            base = naming.simple(inner.args[0]) or ""
            for k, p in enumerate(_shares(tuple(rows.lower(a) for a in inner.args[2 if w else 1 :]))):
                c = weighted(scope, x, w, p) if w else percentile(scope, x, p)
                name = names[k] if k < len(names) else f"{kind}_{str(p.value).replace('.', '_')}_{base}"
                out.append((namer.free(name), Val(c, scope.frame)))
        else:
            v = scope.lower(inner)
            out.append((namer.free(names[0] if names else naming.of_aggregate(inner)), v))
    return out


@operator("summarize")
def summarize(lowering, frame, op, env):
    row_scope = Scope(lowering, frame, env)
    namer = naming.Namer()
    keys = []
    if op.by:
        for name, v, _ in _named(row_scope, op.by, namer, naming.of_key):
            keys.append((name, v))
    # Keys become columns first, so that aggregates may use names that keys shadow.
    key_columns = []
    for name, v in keys:
        hidden = fresh("k")
        row_scope.frame = row_scope.frame.with_df(row_scope.frame.df.withColumn(hidden, v.col))
        key_columns.append((hidden, name, v))
    scope = Scope(lowering, row_scope.frame, env, aggregating=True)
    scope.windowed = False
    named = aggregates(scope, op.exprs, namer)
    within = [k for k in frame.keys if not any(h == k for h, _, _ in key_columns)]
    carried = [c for c in frame.hidden if c.startswith("__pw_src")]
    group = [quoted(h) for h, _, _ in key_columns] + [quoted(k) for k in within]
    df = scope.frame.df
    aliases = [fresh("a") for _ in named]
    micros = {a: fresh("us") for a, (_, v) in zip(aliases, named, strict=True) if v.micros is not None}
    cols = [v.col.alias(a) for a, (_, v) in zip(aliases, named, strict=True)] + [v.micros.alias(micros[a]) for a, (_, v) in zip(aliases, named, strict=True) if a in micros] + [F.first(quoted(c)).alias(c) for c in carried]
    if not cols:
        out = df.select(*group).distinct()
        made = []
    else:
        out = (df.groupBy(*group) if group else df.groupBy()).agg(*cols)
        made = out.columns[len(group) : len(group) + len(named)]
    shown = [json_alias(quoted(h), n) if v.json else quoted(h).alias(n) for h, n, v in key_columns]
    shown_names = {n for _, n, _ in key_columns}
    extra = []
    for k in within:
        # The partition key is a column of the result; hidden ones stay hidden.
        (shown if not k.startswith("__pw") and k not in shown_names else extra).append(quoted(k))
    for h, (n, v) in zip(made, named, strict=True):
        if h in micros:
            shown.append(quoted(h).alias(n, metadata={MICROS: micros[h]}))
            extra.append(quoted(micros[h]))
            continue
        shown.append(json_alias(quoted(h), n) if v.json else (quoted(h).cast("string") if isinstance(out.schema[h].dataType, T.NullType) else quoted(h)).alias(n))
    return Frame(out.select(*shown, *extra, *[quoted(c) for c in carried]), (), frame.keys)


