"""mv-expand and mv-apply: arrays to rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import QueryError, Val
from pipewright.functions.bags import raw_entries
from pipewright.lang.tree import Named, Query
from pipewright.operators.base import operator
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import Frame, fresh, json_alias, quoted
from pipewright.plans.naming import of_expression


def elements(v: Val, as_arrays: bool = False):
    """(array of the value's elements, element type or None for JSON text).  A bag gives one-key bags, another value
    itself, a null one null."""
    if v.is_array:
        return F.when(v.col.isNull(), F.array(F.lit(None).cast(v.type.elementType))).otherwise(v.col), v.type.elementType
    if isinstance(v.type, T.MapType):
        return F.transform(F.map_entries(v.col), lambda e: F.to_json(F.map_from_entries(F.array(e)))), None
    if not v.is_string:
        return F.array(v.col), v.type
    first = F.substring(F.ltrim(v.col), 1, 1)
    if as_arrays:
        bags = F.transform(F.map_entries(raw_entries(v.col)), lambda e: F.concat(F.lit("["), F.to_json(F.array(e["key"])).substr(F.lit(2), F.char_length(F.to_json(F.array(e["key"]))) - 2), F.lit(","), F.to_json(e["value"]), F.lit("]")))
    else:
        bags = F.transform(F.map_entries(raw_entries(v.col)), lambda e: F.to_json(F.map_from_entries(F.array(e))))
    return F.when(first == "[", F.from_json(v.col, "array<string>")).when(first == "{", bags).otherwise(F.array(v.col)), None


def expand(lowering, frame: Frame, op, env) -> tuple[Frame, list[str]]:
    """The exploded frame and the names of the expanded columns."""
    scope = Scope(lowering, frame, env)
    arrays = []
    for e, typeof in op.items:
        inner = e.expr if isinstance(e, Named) else e
        v = scope.lower(inner)
        name = e.names[0] if isinstance(e, Named) else of_expression(inner)
        if name is None:
            raise QueryError(f"{op.kind}: the expression needs a name")
        a, kind = elements(v, op.options.get("kind") == "array" or op.options.get("bagexpansion") == "array")
        arrays.append((name, a, kind, typeof))
    index = op.options.get("with_itemindex")
    packed = fresh("mv")
    if len(arrays) == 1:
        whole = arrays[0][1]
    else:
        whole = F.arrays_zip(*[a.alias(f"v{k}") for k, (_, a, _, _) in enumerate(arrays)])
    if op.limit is not None:
        whole = F.slice(whole, 1, int(scope.constant(op.limit)))
    position = fresh("at")
    df = scope.frame.df.select("*", F.posexplode(whole).alias(position, packed)) if index else scope.frame.df.select("*", F.explode(whole).alias(packed))
    made = {}
    for k, (name, _, kind, typeof) in enumerate(arrays):
        c = quoted(packed) if len(arrays) == 1 else quoted(packed)[str(k)] if f"v{k}" not in df.schema[packed].dataType.names else quoted(packed)[f"v{k}"]
        if typeof and typeof != "dynamic":
            made[name] = K.cast(c, kind or T.StringType(), typeof).alias(name)
        else:
            made[name] = json_alias(c, name) if kind is None else c.alias(name)
    columns = [made.get(c, quoted(c)) for c in frame.columns] + [c for n, c in made.items() if n not in frame.columns]
    if index:
        columns.append(quoted(position).cast("long").alias(index))
    f = scope.frame.with_df(df)
    out = f.select_visible(columns, set(frame.columns) - set(made))
    drop = [c for c in (packed, position) if c in out.df.columns]
    return out.with_df(out.df.drop(*drop)), list(made)


@operator("mv-expand")
def mv_expand(lowering, frame, op, env):
    return expand(lowering, frame, op, env)[0]


@operator("mv-apply")
def mv_apply(lowering, frame, op, env):
    """The sub-pipeline over each row's elements: the row's number is its partition key, and its columns travel in
    one struct, so that an aggregate there needs no join to get them back."""
    row, source = fresh("row"), fresh("src")
    tagged = frame.df.withColumn(row, F.monotonically_increasing_id()).withColumn(source, F.struct(*[quoted(c) for c in frame.columns]))
    inner, expanded = expand(lowering, frame.with_df(tagged, order=(), keys=(row,)), op, env)
    out = lowering.query(Query(None, op.query.ops), env, inner)
    have = out.columns
    missing = [c for c in frame.columns if c not in have and c not in expanded]
    src = [c for c in out.df.columns if c == source]
    cols = [quoted(c) if c in have else quoted(source)[c].alias(c, metadata=frame.fields[c].metadata) for c in frame.columns if c in have or src and c in missing]
    cols += [quoted(c) for c in have if c not in frame.columns]
    return Frame(out.df.select(*cols), (), frame.keys)
