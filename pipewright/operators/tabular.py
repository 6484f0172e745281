"""Row-wise operators: filters, projections, order and plain set operations."""

from __future__ import annotations

import fnmatch
import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import QueryError, Val
from pipewright.lang.tree import Bin, Call, Name, Named, Query, Star
from pipewright.operators.base import operator
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import HIDDEN, Frame, fresh, json_alias, quoted
from pipewright.plans.naming import Namer, of_expression


def conjuncts(e):
    if isinstance(e, Bin) and e.op == "and":
        return [*conjuncts(e.left), *conjuncts(e.right)]
    return [e]


@operator("where", "filter")
def where(lowering, frame, op, env):
    """Conjuncts with ``in (table)`` become semi and anti joins; each other one is a filter, so that it is pushed down.
    Window functions see all rows that come in, whatever the other conjuncts say."""
    scope = Scope(lowering, frame, env)
    conditions, members = [], []
    for part in conjuncts(op.predicate):
        if isinstance(part, Bin) and part.op in ("in", "!in", "in~", "!in~") and len(part.right.items) == 1 and lowering.is_table(part.right.items[0], env):
            members.append(part)
            continue
        scope.windowed = False
        c = scope.lower(part).bool
        conditions.append(quoted(scope.hoist(c)) if scope.windowed else c)
    frame = scope.frame
    for c in conditions:
        frame = frame.with_df(frame.df.where(c))
    for part in members:
        frame = _membership(lowering, frame, part, env)
    return frame


def _membership(lowering, frame, part, env):
    scope = Scope(lowering, frame, env)
    x = scope.lower(part.left)
    other = lowering.query(part.right.items[0], env)
    first = other.columns[0]
    y = Val(quoted(first), other)
    name, key = fresh("in"), fresh("key")
    fold = part.op.endswith("~")
    a, b = (F.upper(x.s), F.upper(y.s)) if fold else (x.col, y.col if K.name_of(x.type) == K.name_of(y.type) or not x.is_string else y.s)
    right = other.df.select(b.alias(name)).distinct()
    df = scope.frame.df.withColumn(key, a)
    how = "left_anti" if part.op.startswith("!") else "left_semi"
    out = scope.frame.with_df(df.join(right, F.col(key) == F.col(name), how).drop(key))
    # A join may shuffle: rows that were sorted are sorted again.
    return out.with_df(out.df.orderBy(*out.ordering())) if out.order and not out.keys else out


def _named(scope, exprs, namer, name_of=of_expression):
    """(name, value, taken over unchanged) of each expression of a projection."""
    out = []
    for e in exprs:
        if isinstance(e, Star):
            for c in scope.frame.columns:
                out.append((namer.free(c), scope.lower(Name(c)), True))
            continue
        inner = e.expr if isinstance(e, Named) else e
        v = scope.lower(inner)
        if isinstance(e, Named) and len(e.names) > 1:
            for k, n in enumerate(e.names):
                part = F.get(v.arr, k) if v.is_array or v.json else v.col.getField(v.type.names[k])
                out.append((namer.free(n), Val(part, scope.frame, json=v.json), False))
            continue
        name = e.names[0] if isinstance(e, Named) else name_of(e)
        out.append((namer.free(name), v, isinstance(inner, Name) and inner.id == name))
    return out


def aliased(v, name):
    if v.json:
        return json_alias(v.col, name)
    c = v.col
    return c.cast("string").alias(name) if isinstance(v.type, T.NullType) else c.alias(name)


@operator("project")
def project(lowering, frame, op, env):
    scope = Scope(lowering, frame, env)
    named = _named(scope, op.exprs, Namer())
    frame = scope.frame
    kept = {n for n, _, same in named if same}
    cols = [aliased(v, n) for n, v, _ in named]
    return frame.select_visible(cols, kept)


@operator("extend", "serialize")
def extend(lowering, frame, op, env):
    """New columns at the end, old names replaced in place; all see the columns as they were before."""
    if not op.exprs:
        return frame
    scope = Scope(lowering, frame, env)
    names = set(frame.columns)
    made: dict[str, Val] = {}
    unnamed = Namer(frame.columns)
    for e in op.exprs:
        inner = e.expr if isinstance(e, Named) else e
        v = scope.lower(inner)
        if isinstance(e, Named) and len(e.names) > 1:
            for k, n in enumerate(e.names):
                made[n] = Val(F.get(v.arr, k) if v.is_array or v.json else v.col.getField(v.type.names[k]), scope.frame, json=v.json)
            continue
        name = e.names[0] if isinstance(e, Named) else of_expression(inner)
        if not isinstance(e, Named) and isinstance(inner, Name):
            continue
        if name is None or not isinstance(e, Named) and name in names and not isinstance(inner, Call):
            name = unnamed.free(None)
        made[name] = v
    frame = scope.frame
    kept = names - set(made)
    cols = [aliased(made.pop(c), c) if c in made else quoted(c) for c in frame.columns]
    cols += [aliased(v, n) for n, v in made.items()]
    return frame.select_visible(cols, kept)


def match(patterns, columns):
    """Columns that each pattern names, in the patterns' order."""
    out = []
    for p in patterns:
        name = p[0] if isinstance(p, tuple) else p
        found = [c for c in columns if fnmatch.fnmatchcase(c, name)] if "*" in name else [name]
        if "*" not in name and name not in columns:
            raise QueryError(f"no column {name!r}")
        if isinstance(p, tuple):
            found = sorted(found, reverse=p[1] == "desc")
        out += [c for c in found if c not in out]
    return out


def _keep(frame, names):
    return frame.select_visible([quoted(c) for c in names], set(names))


@operator("project-away")
def project_away(_lowering, frame, op, _env):
    gone = match(op.patterns, frame.columns)
    return _keep(frame, [c for c in frame.columns if c not in gone])


@operator("project-keep")
def project_keep(_lowering, frame, op, _env):
    kept = match(op.patterns, frame.columns)
    return _keep(frame, [c for c in frame.columns if c in kept])


@operator("project-reorder")
def project_reorder(_lowering, frame, op, _env):
    explicit = [p for p in op.patterns if (p[0] if isinstance(p, tuple) else p) != "*"]
    first = match(explicit, frame.columns)
    return _keep(frame, [*first, *[c for c in frame.columns if c not in first]])


@operator("project-rename")
def project_rename(_lowering, frame, op, _env):
    new = {}
    for e in op.exprs:
        if not isinstance(e, Named) or not isinstance(e.expr, Name):
            raise QueryError("project-rename takes new=old")
        if e.expr.id not in frame.columns:
            raise QueryError(f"no column {e.expr.id!r}")
        new[e.expr.id] = e.names[0]
    df = frame.df.withColumnsRenamed(new)
    return frame.with_df(df, order=tuple((new.get(n, n), a, f) for n, a, f in frame.order), keys=tuple(new.get(k, k) for k in frame.keys))


@operator("project-by-names")
def project_by_names(lowering, frame, op, env):
    scope = Scope(lowering, frame, env)
    names = []
    for e in op.exprs:
        v = scope.constant(e)
        names += v if isinstance(v, list) else [v]
    return _keep(frame, match([n for n in names if "*" in n or n in frame.columns], frame.columns))


# Order.
def sorted_frame(lowering, frame, keys, env):
    scope = Scope(lowering, frame, env)
    order = []
    for e, ascending, first in keys:
        inner = e.expr if isinstance(e, Named) else e
        if isinstance(inner, Name) and inner.id in scope.frame.fields:
            order.append((inner.id, ascending, first))
        else:
            order.append((scope.hoist(scope.lower(inner).col), ascending, first))
    return scope.frame.with_df(scope.frame.df, order=tuple(order))


@operator("sort", "order")
def sort(lowering, frame, op, env):
    out = sorted_frame(lowering, frame, op.keys, env)
    # Inside a partition the order only matters to windows.
    return out if out.keys else out.with_df(out.df.orderBy(*out.ordering()))


def first_rows(frame, n):
    """The first n rows, per partition key if there is one."""
    if not frame.keys:
        return frame.with_df(frame.df.limit(n))
    rank = fresh("n")
    df = frame.df.withColumn(rank, F.row_number().over(frame.window())).where(F.col(rank) <= n).drop(rank)
    return frame.with_df(df)


@operator("take", "limit")
def take(lowering, frame, op, env):
    return first_rows(frame, int(Scope(lowering, frame, env).constant(op.n)))


@operator("top")
def top(lowering, frame, op, env):
    out = sorted_frame(lowering, frame, op.keys, env)
    n = int(Scope(lowering, frame, env).constant(op.n))
    return first_rows(out, n) if out.keys else out.with_df(out.df.orderBy(*out.ordering()).limit(n))


@operator("sample")
def sample(lowering, frame, op, env):
    n = int(Scope(lowering, frame, env).constant(op.n))
    return frame.plain(frame.df.orderBy(F.rand()).limit(n))


@operator("sample-distinct")
def sample_distinct(lowering, frame, op, env):
    scope = Scope(lowering, frame, env)
    (name, v, _), = _named(scope, [op.expr], Namer())
    n = int(scope.constant(op.n))
    return Frame(scope.frame.df.select(aliased(v, name)).distinct().orderBy(F.rand()).limit(n))


@operator("distinct")
def distinct(lowering, frame, op, env):
    scope = Scope(lowering, frame, env)
    cols = [quoted(c) for c in frame.columns] if isinstance(op.exprs[0], Star) else [aliased(v, n) for n, v, _ in _named(scope, op.exprs, Namer())]
    keys = [quoted(k) for k in scope.frame.keys if k.startswith(HIDDEN)]
    return scope.frame.plain(scope.frame.df.select(*cols, *keys).distinct())


@operator("count")
def count(_lowering, frame, _op, _env):
    if frame.keys:
        return frame.plain(frame.df.groupBy(*[quoted(k) for k in frame.keys]).agg(F.count(F.lit(1)).alias("Count")))
    return Frame(frame.df.agg(F.count(F.lit(1)).alias("Count")))


@operator("partition")
def partition(lowering, frame, op, env):
    """The sub-pipeline runs for all keys at once: they partition its windows and group its aggregates."""
    if op.key not in frame.columns:
        raise QueryError(f"no column {op.key!r}")
    out = lowering.query(Query(None, op.query.ops), env, frame.with_df(frame.df, keys=(op.key,), order=()))
    return Frame(out.result())


# Union.
@operator("union")
def union(lowering, frame, op, env):
    """Columns by name; strings that a table lacks are empty, other values null."""
    members = [] if frame is None else [(frame.name or "union_arg0", frame)]
    for t in op.tables:
        if isinstance(t, str):
            members += [(n, lowering.table(n, env)) for n in lowering.matching(t, env)]
        else:
            f = lowering.query(t, env)
            members.append((t.source.id if not t.ops and isinstance(t.source, Name) else f"union_arg{len(members)}", f))
    if not members:
        raise QueryError("union: no table matches")
    label = op.options.get("withsource")
    names: dict[str, T.DataType] = {}
    json = set()
    for _, f in members:
        for c in f.columns:
            names.setdefault(c, f.fields[c].dataType)
            if f.is_json(c):
                json.add(c)
    if op.options.get("kind") == "inner":
        names = {c: t for c, t in names.items() if all(c in f.columns for _, f in members)}
    target = {c: functools.reduce(_wider, [f.fields[c].dataType for _, f in members if c in f.columns]) for c in names}
    parts = []
    for source, f in members:
        cols = [F.lit(source).alias(label)] if label else []
        for c, t in target.items():
            if c not in f.columns:
                x = F.lit("" if isinstance(t, T.StringType) and c not in json else None).cast(t)
            else:
                have = f.fields[c].dataType
                x = quoted(c) if have == t else K.text(quoted(c), have) if isinstance(t, T.StringType) else quoted(c).cast(t)
            cols.append(json_alias(x, c) if c in json else x.alias(c))
        parts.append(f.df.select(*cols))
    return Frame(functools.reduce(lambda a, b: a.unionByName(b), parts))


def _wider(a, b):
    if a == b:
        return a
    if K.is_number(a) and K.is_number(b):
        return T.LongType() if K.is_integral(a) and K.is_integral(b) else T.DoubleType()
    return T.StringType()
