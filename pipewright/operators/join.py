"""join and lookup.  Strategies are Catalyst's and AQE's choice from measured sizes; hints only steer them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import QueryError
from pipewright.lang.tree import Bin, Name, Path
from pipewright.operators.base import operator
from pipewright.operators.tabular import conjuncts
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import Frame, estimated_bytes, fresh, json_alias, quoted

#: Largest estimated size, in bytes, that ``hint.strategy=broadcast`` may ship to every executor.
BROADCAST_BYTES = 256 << 20
#: Largest estimated size, in bytes, of a side that is dealt out anew before a join, and tasks per core that it goes to.
DEALT_BYTES = 1 << 30
DEALT_TASKS = 4
_KINDS = {"inner": "inner", "innerunique": "inner", "leftouter": "left", "rightouter": "right", "fullouter": "full", "leftsemi": "left_semi", "rightsemi": "left_semi", "leftanti": "left_anti", "anti": "left_anti", "leftantisemi": "left_anti", "rightanti": "left_anti", "rightantisemi": "left_anti"}


def hinted(df: DataFrame, options: dict[str, str]) -> DataFrame:
    strategy = options.get("hint.strategy", "").lower()
    if strategy == "broadcast" and estimated_bytes(df) <= BROADCAST_BYTES:
        return F.broadcast(df)
    return df.hint("shuffle_hash") if strategy == "shuffle" else df


def dealt_out(left: DataFrame, right: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    """The two sides, with the one that a broadcast join streams over dealt out over all cores where it is small: one
    file split can be a whole table, and one task would then write all pairs of keys that repeat on both sides."""
    sizes = estimated_bytes(left), estimated_bytes(right)
    streamed = {"left": 0, "right": 1}.get(how, 0 if sizes[0] >= sizes[1] else 1)
    if how not in ("inner", "left", "right") or sizes[streamed] > DEALT_BYTES:
        return left, right
    tasks = DEALT_TASKS * left.sparkSession.sparkContext.defaultParallelism
    return (left.repartition(tasks), right) if streamed == 0 else (left, right.repartition(tasks))


def keys_of(on: list) -> tuple[list[tuple[str, str]], list]:
    """(left column, right column) of the equalities, and the other conditions."""
    equal, rest = [], []
    for part in (c for e in on for c in conjuncts(e)):
        if isinstance(part, Name):
            equal.append((part.id, part.id))
            continue
        if isinstance(part, Bin) and part.op == "==":
            sides = {}
            for x in (part.left, part.right):
                if isinstance(x, Path) and isinstance(x.base, Name) and x.base.id in ("$left", "$right"):
                    sides[x.base.id] = x.key
            if len(sides) == 2:
                equal.append((sides["$left"], sides["$right"]))
                continue
        rest.append(part)
    return equal, rest


def free_name(name: str, taken: set[str]) -> str:
    if name not in taken:
        return name
    k = 1
    while f"{name}{k}" in taken:
        k += 1
    return f"{name}{k}"


def _comparable(left: Frame, a: str, right: Frame, b: str):
    """The two key columns, of one type."""
    x, y = quoted(a), quoted(b)
    ta, tb = left.fields[a].dataType, right.fields[b].dataType
    if ta != tb and isinstance(ta, T.StringType) != isinstance(tb, T.StringType):
        x, y = (x if isinstance(ta, T.StringType) else K.text(x, ta)), (y if isinstance(tb, T.StringType) else K.text(y, tb))
    return x, y


def _padded(c, frame: Frame, name: str, alias: str, pad: bool):
    if frame.is_json(name):
        return json_alias(c, alias)
    return F.coalesce(c, F.lit("")).alias(alias) if pad and isinstance(frame.fields[name].dataType, T.StringType) else c.alias(alias)


def joined(lowering, left: Frame, right: Frame, op, env, kind: str, drop_right_keys: bool) -> Frame:
    how = _KINDS.get(kind)
    if how is None:
        raise QueryError(f"no join kind {kind!r}")
    equal, rest = keys_of(op.on)
    for side, frame, k in (("left", left, 0), ("right", right, 1)):
        for pair in equal:
            if pair[k] not in frame.columns:
                raise QueryError(f"the {side} side has no column {pair[k]!r}")
    if how in ("left_semi", "left_anti") and kind.startswith("right"):
        left, right = right, left
        equal = [(b, a) for a, b in equal]
        swapped = {"$left": "$right", "$right": "$left"}
    else:
        swapped = {"$left": "$left", "$right": "$right"}
    if kind == "innerunique" and equal:
        left = left.with_df(left.df.dropDuplicates([a for a, _ in equal]), order=())
    taken = set(left.columns)
    out_name = {}
    for c in right.columns:
        if drop_right_keys and any(b == c for _, b in equal):
            out_name[c] = fresh("r")
            continue
        out_name[c] = free_name(c, taken)
        taken.add(out_name[c])
    side = {c: fresh("r") for c in right.columns}
    r = hinted(right.df.select(*[quoted(c).alias(side[c], metadata=right.fields[c].metadata) for c in right.columns]), op.options)
    renamed = Frame(r)
    condition = None
    for a, b in equal:
        x, y = _comparable(left, a, renamed, side[b])
        # Semi and anti joins compare plainly, as a null key has no partner there; the others let nulls meet.
        one = x == y if how in ("left_semi", "left_anti") else x.eqNullSafe(y)
        condition = one if condition is None else condition & one
    l_df = left.df.select(*[quoted(c) for c in left.columns], *[quoted(k) for k in left.hidden if k in left.keys])
    if rest:
        both = Frame(l_df.crossJoin(r))
        scope = Scope(lowering, both, env)
        scope.sides = {swapped["$left"]: {c: c for c in left.columns}, swapped["$right"]: dict(side)}
        for part in rest:
            one = scope.lower(part).bool
            condition = one if condition is None else condition & one
    if condition is None:
        condition = F.lit(True)
    if equal:
        l_df, r = dealt_out(l_df, r, how)
    df = l_df.join(r, condition, how)
    keys = tuple(k for k in left.keys)
    if how in ("left_semi", "left_anti"):
        return Frame(df, (), keys if kind[:5] != "right" else ())
    cols = [_padded(quoted(c), left, c, c, how in ("right", "full")) for c in left.columns]
    cols += [_padded(quoted(side[c]), right, c, out_name[c], how in ("left", "full")) for c in right.columns if not out_name[c].startswith("__pw")]
    return Frame(df.select(*cols, *[quoted(k) for k in left.hidden if k in keys]), (), keys)


@operator("join")
def join(lowering, frame, op, env):
    right = lowering.query(op.right, env)
    return joined(lowering, frame, right, op, env, op.options.get("kind", "innerunique").lower(), False)


@operator("lookup")
def lookup(lowering, frame, op, env):
    """A left (or inner) join whose right side is a dimension; the right keys are dropped."""
    right = lowering.query(op.right, env)
    return joined(lowering, frame, right, op, env, op.options.get("kind", "leftouter").lower(), True)
