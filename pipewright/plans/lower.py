"""The lowering: queries and bindings to frames."""

from __future__ import annotations

import fnmatch
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.functions import QueryError, Val
from pipewright.lang.tree import Call, DataTable, ExternalData, Function, Let, Lit, Name, Named, Op, Query
from pipewright.operators import OPERATORS
from pipewright.plans import serial
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import Frame
from pipewright.sources import readers

#: name -> DataFrame of it, or None
Resolver = Any


class Lowering:
    """One query's context.  ``tables`` finds a table by name, ``functions`` are stored ones (name -> Function)."""

    def __init__(self, spark: SparkSession, tables: Resolver, names: Any, functions: dict[str, Function]):
        self.spark, self.tables, self.names = spark, tables, names
        #: Stored functions; each sees all of them.
        self.globals: dict[str, Any] = {}
        self.globals |= {n: ("function", f, self.globals) for n, f in functions.items()}
        self.render: Any = None
        #: Names bound by ``as``.
        self.named: dict[str, Frame] = {}

    # Bindings: name -> ("table", ast, env) | ("frame", Frame) | ("scalar", ast, env) | ("function", Function, env) | Val
    def script(self, lets: list[Let], query: Any) -> Frame:
        env = dict(self.globals)
        for let in lets:
            env = self.bind(let, env)
        if query is None:
            raise QueryError("there is no query")
        return self.query(query, env)

    def bind(self, let: Let, env: dict[str, Any]) -> dict[str, Any]:
        env = dict(env)
        v = let.value
        if isinstance(v, Function):
            env[let.name] = ("function", v, dict(env))
        elif self.is_table(v, env):
            env[let.name] = ("table", v, dict(env))
        else:
            env[let.name] = ("scalar", v, dict(env))
        return env

    def is_table(self, e: Any, env: dict[str, Any]) -> bool:
        if isinstance(e, (DataTable, ExternalData)):
            return True
        if isinstance(e, Op):
            return True
        if isinstance(e, Query):
            return bool(e.ops) or self.is_table(e.source, env)
        if isinstance(e, Call):
            if e.name in ("materialize", "view", "table"):
                return True
            b = env.get(e.name)
            return isinstance(b, tuple) and b[0] == "function" and self._tabular(b)
        if isinstance(e, Name):
            if e.id in env:
                b = env[e.id]
                if isinstance(b, tuple) and b[0] == "function":
                    return self._tabular(b)
                return isinstance(b, tuple) and b[0] in ("table", "frame")
            return e.id in self.named or self.tables(e.id) is not None
        return False

    def _tabular(self, b: tuple) -> bool:
        f: Function = b[1]
        env = dict(b[2])
        for n, kind, _ in f.params:
            env[n] = ("frame", None) if isinstance(kind, list) else Val(F.lit(None), None)
        for let in f.statements:
            env = self.bind(let, env)
        return self.is_table(f.body, env)

    def arguments(self, f: Function, args: list, env: dict[str, Any], caller: Any, first: Frame | None = None) -> dict[str, Any]:
        """The bindings of a call: ``caller`` is the scope of scalar arguments, or the environment of a tabular call."""
        out = dict(env)
        given: dict[str, Any] = {}
        position = [n for n, _, _ in f.params]
        for a in args:
            if isinstance(a, Named):
                given[a.names[0]] = a.expr
        rest = iter([a for a in args if not isinstance(a, Named)])
        for k, (n, kind, default) in enumerate(f.params):
            if k == 0 and first is not None:
                out[n] = ("frame", first)
                continue
            value = given[n] if n in given else next(rest, default)
            if value is None:
                raise QueryError(f"the argument {n!r} is missing")
            source = caller.env if isinstance(caller, Scope) else caller
            if isinstance(kind, list):
                out[n] = ("frame", self.query(value, source))
            elif isinstance(caller, Scope):
                out[n] = caller.lower(value)
            else:
                out[n] = ("scalar", value, source)
        if next(rest, None) is not None:
            raise QueryError(f"too many arguments: {', '.join(position)}")
        return out

    # Tabular expressions.
    def query(self, q: Any, env: dict[str, Any], frame: Frame | None = None) -> Frame:
        if not isinstance(q, Query):
            return self.source(q, env)
        out = frame if q.source is None else self.source(q.source, env)
        if out is None:
            raise QueryError("the pipeline has no source")
        for op in q.ops:
            out = self.apply(out, op, env)
        return out

    def apply(self, frame: Frame | None, op: Op, env: dict[str, Any]) -> Frame:
        if op.kind not in OPERATORS:
            raise QueryError(f"the operator {op.kind!r} is not supported")
        out = OPERATORS[op.kind](self, frame, op, env)
        # Window functions leave their rows in parts: they are sorted again for what follows.
        return serial.in_order(out) if serial.is_spread(out) and (frame is None or out.order != frame.order) else out

    def source(self, e: Any, env: dict[str, Any]) -> Frame:
        if isinstance(e, Query):
            return self.query(e, env)
        if isinstance(e, Op):
            return self.apply(None, e, env)
        if isinstance(e, DataTable):
            return Frame(readers.inline(self, e, env))
        if isinstance(e, ExternalData):
            return Frame(readers.external(self.spark, e.columns, e.uris, e.options))
        if isinstance(e, Call):
            return self._call(e, env)
        if isinstance(e, Name):
            return self.table(e.id, env)
        raise QueryError("a table is expected")

    def table(self, name: str, env: dict[str, Any]) -> Frame:
        if name in env:
            b = env[name]
            if isinstance(b, tuple):
                if b[0] == "frame":
                    return b[1]
                if b[0] == "table":
                    # Evaluated once: later uses share the plan, and Spark reuses its exchanges.
                    f = self.query(b[1], b[2])
                    env[name] = ("frame", f)
                    return f
                if b[0] == "function":
                    return self._call(Call(name, []), env)
            raise QueryError(f"{name!r} is a value, not a table")
        if name in self.named:
            return self.named[name]
        df: DataFrame | None = self.tables(name)
        if df is None:
            raise QueryError(f"no table {name!r}")
        return Frame(df, name=name)

    def _call(self, e: Call, env: dict[str, Any]) -> Frame:
        if e.name == "view":
            return self.query(e.args[0], env)
        if e.name == "materialize":
            # Computed once, when it is first needed, and kept by the executors (on disk where memory is short).
            frame = self.query(e.args[0], env)
            return frame.with_df(frame.df.persist())
        if e.name == "table":
            a = e.args[0]
            return self.table(a.value if isinstance(a, Lit) else a.id, env)
        return self.call(e.name, e.args, env)

    def call(self, name: str, args: list, env: dict[str, Any], first: Frame | None = None) -> Frame:
        """A tabular function, ``first`` being the piped-in table of ``invoke``."""
        b = env.get(name)
        if not isinstance(b, tuple) or b[0] != "function":
            raise QueryError(f"no function {name!r}")
        f: Function = b[1]
        inner = self.arguments(f, args, b[2], env if first is None else Scope(self, first, env), first)
        for let in f.statements:
            inner = self.bind(let, inner)
        return self.query(f.body, inner)

    def matching(self, pattern: str, env: dict[str, Any]) -> list[str]:
        """Names of tables and tabular bindings that a wildcard matches, in order."""
        known = {n for n, b in env.items() if isinstance(b, tuple) and b[0] in ("table", "frame")} | set(self.names())
        return sorted(n for n in known if fnmatch.fnmatchcase(n, pattern))
