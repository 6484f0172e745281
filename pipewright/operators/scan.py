"""scan: state carried along the serialized rows.

Single-step scans whose state is a running aggregate stay in the JVM as windows.  Any other scan is a sequential
loop per partition in an Arrow-batched grouped map; a scan without a partition is one sequence and so one task.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pipewright import ship
from pipewright import types as K
from pipewright.functions import QueryError
from pipewright.lang.tree import Bin, Call, Lit, Name, Named, Path, Un
from pipewright.operators.base import operator
from pipewright.operators.tabular import sorted_frame
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import Frame, fresh, quoted


def _uses_state(e: Any, steps: set[str]) -> bool:
    if isinstance(e, Path):
        return isinstance(e.base, Name) and e.base.id in steps
    if isinstance(e, (list, tuple)):
        return any(_uses_state(x, steps) for x in e)
    if hasattr(e, "__dataclass_fields__"):
        return any(_uses_state(getattr(e, f), steps) for f in e.__dataclass_fields__)
    return False


def _names(e: Any) -> set[str]:
    if isinstance(e, Name):
        return {e.id}
    if isinstance(e, (list, tuple)):
        return set().union(*[_names(x) for x in e]) if e else set()
    if hasattr(e, "__dataclass_fields__"):
        return set().union(*[_names(getattr(e, f)) for f in e.__dataclass_fields__])
    return set()


def _is_state(e: Any, step: str, column: str) -> bool:
    return isinstance(e, Path) and isinstance(e.base, Name) and e.base.id == step and e.key == column


@operator("scan")
def scan(lowering, frame, op, env):
    if op.partition:
        scope = Scope(lowering, frame, env)
        keys = []
        for e in op.partition:
            inner = e.expr if isinstance(e, Named) else e
            keys.append(inner.id if isinstance(inner, Name) else scope.hoist(scope.lower(inner).col))
        frame = scope.frame.with_df(scope.frame.df, keys=tuple(keys))
    if op.order:
        frame = sorted_frame(lowering, frame, op.order, env)
    declared = {n: (kind, default) for n, kind, default in op.declare}
    if len(op.steps) == 1 and not op.options:
        name, _, output, predicate, assigns = op.steps[0]
        if output == "all":
            quick = _as_windows(lowering, frame, env, name, predicate, assigns, declared)
            if quick is not None:
                return quick
    return _sequential(lowering, frame, env, op, declared)


def _as_windows(lowering, frame, env, step, predicate, assigns, declared):
    """The scan as window functions, or None if its state is more than a running aggregate."""
    if _uses_state(predicate, {step}):
        return None
    targets = [c for c, _ in assigns]
    scope = Scope(lowering, frame, env)
    always = isinstance(predicate, Lit) and predicate.value is True
    frame0 = frame if always else scope.frame.with_df(scope.frame.df.where(scope.lower(predicate).bool))
    scope = Scope(lowering, frame0, env)
    made = {}
    running = scope._running() if any(_uses_state(e, {step}) for _, e in assigns) else None
    for c, e in assigns:
        if (_names(e) - {step}) & (set(targets) | set(declared)):
            return None
        if not _uses_state(e, {step}):
            made[c] = scope.lower(e).col
            continue
        default = scope.lower(declared[c][1]) if c in declared and declared[c][1] is not None else None
        other = None
        if isinstance(e, Bin) and e.op == "+":
            other = e.right if _is_state(e.left, step, c) else e.left if _is_state(e.right, step, c) else None
            if other is not None and not _uses_state(other, {step}) and default is not None and K.is_number(default.type):
                v = scope.lower(other)
                # A null operand makes the state null for good; only operands that are never null stay here.
                made[c] = default.num + F.when(F.count_if(v.num.isNull()).over(running) == 0, F.sum(v.num).over(running))
                continue
            return None
        if isinstance(e, Call) and e.name in ("max_of", "min_of") and len(e.args) == 2:
            other = e.args[1] if _is_state(e.args[0], step, c) else e.args[0] if _is_state(e.args[1], step, c) else None
            if other is not None and not _uses_state(other, {step}):
                v = scope.lower(other)
                best = (F.max if e.name == "max_of" else F.min)(v.col).over(running)
                pick = F.greatest if e.name == "max_of" else F.least
                made[c] = best if default is None else pick(best, default.col)
                continue
            return None
        if isinstance(e, Call) and e.name in ("iff", "iif", "coalesce"):
            # Fill forward: the state stands in where the value is missing.
            value = e.args[0] if e.name == "coalesce" else e.args[2]
            state = e.args[1]
            empty = e.name == "coalesce" or isinstance(e.args[0], Call) and e.args[0].name in ("isnull", "isempty") and e.args[0].args[0] == value
            if len(e.args) == (2 if e.name == "coalesce" else 3) and empty and _is_state(state, step, c) and not _uses_state(value, {step}):
                v = scope.lower(value)
                there = v.col.isNotNull() if e.name == "coalesce" or e.args[0].name == "isnull" else (v.col.isNotNull() & (v.s != ""))
                last = F.last(F.when(there, v.col), True).over(running)
                made[c] = last if default is None else F.coalesce(last, default.col)
                continue
            return None
        return None
    for c, (kind, default) in declared.items():
        if c not in made:
            made[c] = scope.lower(default).col if default is not None else F.lit(None)
        made[c] = made[c].cast(K.SPARK[kind])
    f = scope.frame
    cols = [made[c].alias(c) if c in made else quoted(c) for c in f.columns] + [x.alias(c) for c, x in made.items() if c not in f.columns]
    return f.select_visible(cols, set(f.columns) - set(made))


# The sequential form.
def _null(f):
    return lambda *a: None if any(x is None for x in a) else f(*a)


def _divide(a, b):
    if isinstance(a, dt.timedelta):
        return a / b if b else None
    if isinstance(a, int) and isinstance(b, int):
        return None if not b else int(a / b) if abs(a) < 1 << 52 else (abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)
    if not b:
        return math.nan if not a or a != a else math.inf if a > 0 else -math.inf
    return a / b


_BINARY = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": _divide, "%": lambda a, b: a % abs(b) if b else None, "==": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "=~": lambda a, b: a.upper() == b.upper(), "contains": lambda a, b: b.lower() in a.lower(), "startswith": lambda a, b: a.lower().startswith(b.lower()), "endswith": lambda a, b: a.lower().endswith(b.lower())}
_CALLS = {
    "abs": _null(abs), "round": _null(lambda x, n=0: math.floor(x * 10**n + 0.5) / 10**n), "floor": _null(math.floor), "ceiling": _null(math.ceil), "sqrt": _null(lambda x: math.sqrt(x) if x >= 0 else math.nan), "exp": _null(math.exp), "log": _null(lambda x: math.log(x) if x > 0 else -math.inf),
    "pow": _null(lambda a, b: a**b), "not": _null(lambda x: not x), "isnan": lambda x: isinstance(x, float) and x != x, "isfinite": _null(math.isfinite), "isinf": _null(math.isinf), "sign": _null(lambda x: (x > 0) - (x < 0)), "isnull": lambda x: x is None, "isnotnull": lambda x: x is not None, "isempty": lambda x: x is None or x == "", "isnotempty": lambda x: x is not None and x != "", "strlen": _null(len),
    "tostring": lambda x: "" if x is None else str(x), "strcat": lambda *a: "".join("" if x is None else str(x) for x in a), "tolower": _null(str.lower), "toupper": _null(str.upper), "toreal": _null(float), "todouble": _null(float), "tolong": _null(int), "toint": _null(int),
    "max_of": lambda *a: max((x for x in a if x is not None), default=None), "min_of": lambda *a: min((x for x in a if x is not None), default=None),
}


def _call(name: str) -> Any:
    if name not in _CALLS:
        raise QueryError(f"scan: {name} is not supported with state")
    return _CALLS[name]


class _Sequence:
    """The state machine of a scan over one partition's rows.  A step's state is the row that it matched last."""

    def __init__(self, steps: list, declared: dict[str, Any], match_id: str | None):
        self.steps, self.declared, self.match_id = steps, declared, match_id
        self.names = [s[0] for s in steps]

    def value(self, e: Any, row: dict, states: list) -> Any:
        if isinstance(e, Lit):
            return dt.timedelta(microseconds=e.value) if e.type == "timespan" and e.value is not None else K.parse_datetime(e.value) if e.type == "datetime" and e.value is not None else e.value
        if isinstance(e, Name):
            return row.get(e.id)
        if isinstance(e, Path):
            state = states[self.names.index(e.base.id)]
            return self.declared.get(e.key) if state is None else state.get(e.key)
        if isinstance(e, Un):
            x = self.value(e.x, row, states)
            return None if x is None else -x if e.op == "-" else x
        if isinstance(e, Bin):
            return self.binary(e, row, states)
        if isinstance(e, Call):
            if e.name in ("iff", "iif"):
                return self.value(e.args[1] if self.value(e.args[0], row, states) else e.args[2], row, states)
            if e.name == "case":
                for c, v in zip(e.args[:-1:2], e.args[1::2], strict=False):
                    if self.value(c, row, states):
                        return self.value(v, row, states)
                return self.value(e.args[-1], row, states)
            if e.name == "coalesce":
                return next((x for x in (self.value(a, row, states) for a in e.args) if x is not None), None)
            if e.name == "between":
                x, a, b = (self.value(v, row, states) for v in e.args)
                return None not in (x, a, b) and a <= x <= b
            return _call(e.name)(*[self.value(a, row, states) for a in e.args])
        raise QueryError(f"scan: {type(e).__name__} is not supported with state")

    def binary(self, e: Bin, row: dict, states: list) -> Any:
        if e.op in ("and", "or"):
            a = self.value(e.left, row, states)
            return bool(a and self.value(e.right, row, states)) if e.op == "and" else bool(a or self.value(e.right, row, states))
        a = self.value(e.left, row, states)
        if e.op in ("in", "!in"):
            found = a in [self.value(i, row, states) for i in e.right.items]
            return found if e.op == "in" else not found
        b = self.value(e.right, row, states)
        if e.op == "!=":
            return a != b
        return None if a is None or b is None else _BINARY[e.op](a, b)

    def run(self, rows: list[dict]) -> list[dict]:
        n = len(self.steps)
        states: list[dict | None] = [None] * n
        ids: list[int | None] = [None] * n
        out, matches = [], 0
        for source in rows:
            # Later steps first, so that one row does not pass several steps of a match.
            for k in reversed(range(n)):
                _, _, output, predicate, assigns = self.steps[k]
                before = list(states)
                done = None
                for prior, row, number in self.ways(k, source, states, ids):
                    if self.value(predicate, row, before):
                        done = dict(row)
                        break
                if done is None:
                    continue
                if k == 0 and (states[0] is None or n > 1):
                    number = matches
                    matches += 1
                for c, e in assigns:
                    done[c] = self.value(e, done, before)
                states[k], ids[k] = done, number
                if prior is not None:
                    # The match moved on.
                    for j in range(prior, k):
                        states[j], ids[j] = None, None
                if output != "none":
                    out.append({**done, **({self.match_id: number} if self.match_id else {})})
                if k > 0:
                    break
        return out

    def ways(self, k: int, source: dict, states: list, ids: list) -> list[tuple[int | None, dict, int | None]]:
        """(step before or None, row with the state's declared columns, match) of the ways in which a row can match
        step k: a match that waits before it comes first, then one that is in it already."""
        out = []
        if k and self.reached(k, states):
            prior = max(j for j in range(k) if states[j] is not None)
            out.append((prior, {**source, **{c: states[prior].get(c) for c in self.declared}}, ids[prior]))
        if states[k] is not None:
            out.append((None, {**source, **{c: states[k].get(c) for c in self.declared}}, ids[k]))
        elif k == 0:
            out.append((None, {**source, **self.declared}, None))
        return out

    def reached(self, k: int, states: list) -> bool:
        """Is a match waiting before step k, with only optional steps between?"""
        for j in reversed(range(k)):
            if states[j] is not None:
                return True
            if not self.steps[j][1]:
                return False
        return False


class _Single:
    """A scan of one step, its expressions compiled to closures over columns: what :class:`_Sequence` does, faster."""

    def __init__(self, step: tuple, declared: dict[str, Any]):
        self.step, self.declared = step, declared
        self.row: dict[str, Any] = {}
        self.state: dict[str, Any] = declared
        self.at = 0
        #: The row that matched last, as far as the expressions read it.
        self.paths: set[str] = set()
        self.prior: dict[str, Any] = {}
        self.columns: dict[str, list] = {}
        self.predicate = self.compiled(step[3])
        self.assigns = [(c, self.compiled(e)) for c, e in step[4]]

    def needs(self) -> set[str]:
        return ((_names(self.step[3]) | _names([e for _, e in self.step[4]])) - set(self.declared) - {self.step[0]}) | self.paths

    def compiled(self, e: Any):
        if isinstance(e, Lit):
            v = dt.timedelta(microseconds=e.value) if e.type == "timespan" and e.value is not None else K.parse_datetime(e.value) if e.type == "datetime" and e.value is not None else e.value
            return lambda: v
        if isinstance(e, Name):
            name = e.id
            return (lambda: self.row[name]) if name in self.declared else lambda: self.columns[name][self.at]
        if isinstance(e, Path):
            key = e.key
            if key in self.declared:
                return lambda: self.state[key]
            self.paths.add(key)
            return lambda: self.prior.get(key)
        if isinstance(e, Un):
            f = self.compiled(e.x)
            return (lambda: None if (x := f()) is None else -x) if e.op == "-" else f
        if isinstance(e, Bin):
            if e.op in ("in", "!in"):
                f, items, wanted = self.compiled(e.left), [self.compiled(i) for i in e.right.items], e.op == "in"
                return lambda: (f() in [i() for i in items]) == wanted
            a, b = self.compiled(e.left), self.compiled(e.right)
            if e.op == "and":
                return lambda: bool(a() and b())
            if e.op == "or":
                return lambda: bool(a() or b())
            if e.op == "!=":
                return lambda: a() != b()
            f = _BINARY[e.op]
            return lambda: None if (x := a()) is None or (y := b()) is None else f(x, y)
        if isinstance(e, Call):
            args = [self.compiled(a) for a in e.args]
            if e.name in ("iff", "iif"):
                return lambda: args[1]() if args[0]() else args[2]()
            if e.name == "case":
                return lambda: next((v() for c, v in zip(args[:-1:2], args[1::2]) if c()), None) if any(c() for c in args[:-1:2]) else args[-1]()
            if e.name == "coalesce":
                return lambda: next((x for a in args if (x := a()) is not None), None)
            if e.name == "between":
                return lambda: None not in (v := [a() for a in args]) and v[1] <= v[0] <= v[2]
            f = _call(e.name)
            return lambda: f(*[a() for a in args])
        raise QueryError(f"scan: {type(e).__name__} is not supported with state")

    def reset(self) -> None:
        self.state, self.prior = dict(self.declared), {}

    def run(self, columns: dict[str, list], first: int, last: int, out: dict[str, list]) -> list[int]:
        """Goes on over the rows from ``first`` to before ``last``: the numbers of those that match; their declared
        columns are appended to ``out``."""
        self.columns = columns
        hit: list[int] = []
        for k in range(first, last):
            self.at = k
            self.row = dict(self.state)
            if not self.predicate():
                continue
            for c, f in self.assigns:
                self.row[c] = f()
            self.state = self.row
            if self.paths:
                self.prior = {c: columns[c][k] for c in self.paths}
            hit.append(k)
            for c, values in out.items():
                values.append(self.row[c])
        return hit


def _sequential(lowering, frame: Frame, env, op, declared) -> Frame:
    scope = Scope(lowering, frame, env)
    start = {n: (scope.constant(d) if d is not None else None) for n, (_, d) in declared.items()}
    match_id = op.options.get("with_match_id")
    machine = _Sequence(op.steps, start, match_id)
    columns = frame.columns
    keys = list(frame.keys)
    order = [(n, a, f) for n, a, f in frame.order]
    df = frame.df
    fields = [T.StructField(f.name, f.dataType, True, f.metadata) for f in df.schema.fields if f.name not in declared]
    fields += [T.StructField(n, K.SPARK[kind]) for n, (kind, _) in declared.items()]
    if match_id:
        fields.append(T.StructField(match_id, T.LongType()))
    schema = T.StructType(fields)
    position = fresh("row")
    names = [f.name for f in fields]
    ship(lowering.spark)

    simple = len(op.steps) == 1 and op.steps[0][2] != "none" and all(c in declared for c, _ in op.steps[0][4]) and not match_id
    if simple:
        _Single(op.steps[0], start)  # errors before the job runs

    def made_array(values: list, t: T.DataType) -> pa.Array:
        if isinstance(t, (T.LongType, T.IntegerType)):
            # As elsewhere in the language, a number that does not fit is null.
            most = 1 << (63 if isinstance(t, T.LongType) else 31)
            values = [None if v is None or v != v or not -most <= v < most else int(v) for v in values]
        elif isinstance(t, T.DoubleType):
            values = [None if v is None else float(v) for v in values]
        return pa.array(values, to_arrow_type(t))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows as they come, batch by batch: a new key starts anew, however long its rows are."""
        one = _Single(op.steps[0], start)
        one.reset()
        key: Any = None
        for batch in batches:
            n = batch.num_rows
            column = lambda c, batch=batch: batch.column(c).to_pylist()
            given = {c: column(c) for c in one.needs() if c in batch.schema.names}
            own = list(zip(*[column(c) for c in keys], strict=True)) if keys else [()] * n
            made: dict[str, list] = {c: [] for c in declared}
            hit: list[int] = []
            at = 0
            while at < n:
                if own[at] != key:
                    one.reset()
                    key = own[at]
                stop = at + 1
                while stop < n and own[stop] == key:
                    stop += 1
                hit += one.run(given, at, stop, made)
                at = stop
            index = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([made_array(made[f.name], f.dataType) if f.name in declared else batch.column(f.name).take(index) for f in fields], names=names)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scans of several steps: one key's rows at a time.  Columns stay in Arrow; Python sees their values only."""
        held: list[pa.RecordBatch] = []
        key: Any = None

        def matched() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            values = [table.column(c).to_pylist() for c in table.column_names]
            got = machine.run([dict(zip(table.column_names, r, strict=True)) | {position: k} for k, r in enumerate(zip(*values, strict=True))])
            index = pa.array([r[position] for r in got], pa.int64())
            made = {*declared, match_id, *(c for step in op.steps for c, _ in step[4])}
            columns = [made_array([r.get(f.name) for r in got], f.dataType) if f.name in made else table.column(f.name).take(index).combine_chunks() for f in fields]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)

        for batch in batches:
            n = batch.num_rows
            own = list(zip(*[batch.column(c).to_pylist() for c in keys], strict=True)) if keys else [()] * n
            at = 0
            while at < n:
                if held and own[at] != key:
                    yield matched()
                    held = []
                key = own[at]
                stop = at + 1
                while stop < n and own[stop] == key:
                    stop += 1
                held.append(batch.slice(at, stop - at))
                at = stop
        if held:
            yield matched()

    sequence = frame.ordering()
    placed = df.repartition(*[quoted(k) for k in keys]) if keys else df.repartition(1)
    if not order:
        placed = df.withColumn(position, F.monotonically_increasing_id())
        placed = placed.repartition(*[quoted(k) for k in keys]) if keys else placed.repartition(1)
        sequence = [quoted(position)]
    out = placed.sortWithinPartitions(*[quoted(k) for k in keys], *sequence).mapInArrow(stream if simple else several, schema)
    kept = [o for o in order if o[0] in names]
    result = frame.with_df(out, order=tuple(kept) if len(kept) == len(order) else ())
    visible = [c for c in columns if c not in declared] + list(declared) + ([match_id] if match_id else [])
    return result.with_df(out.select(*[quoted(c) for c in visible], *[quoted(c) for c in result.hidden if c != position]))


