"""Expressions of the language as Spark columns."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import FUNCTIONS, QueryError, Val, build
from pipewright.functions.aggregates import AGGREGATES
from pipewright.functions.strings import quote_regex
from pipewright.lang.tree import Bin, Call, DataTable, Function, Index, Items, Lit, Name, Named, Op, Path, Query, Star, Un
from pipewright.plans import serial
from pipewright.plans.frame import MICROS, Frame, fresh, quoted

_WINDOWS = {"row_number", "prev", "next", "row_cumsum", "row_rank_dense", "row_rank_min", "row_window_session"}
#: Operators on text that may also be written as functions.
_TEXT_CALLS = {w + cs for w in ("contains", "startswith", "endswith", "has", "hasprefix", "hassuffix") for cs in ("", "_cs")}
_LETTER = r"[\p{L}\p{N}]"
_BEFORE, _AFTER = rf"(?<!{_LETTER})", rf"(?!{_LETTER})"


class Scope:
    """Lowers expressions over ``frame``; ``env`` holds the bindings of ``let``.  Lowering may add hidden columns to
    the frame (``hoist``): use the scope's frame afterwards."""

    def __init__(self, lowering: Any, frame: Frame, env: dict[str, Any], aggregating: bool = False):
        self.lowering, self.frame, self.env, self.aggregating = lowering, frame, env, aggregating
        self.windowed = False
        #: Columns of window functions that are made already.
        self.made: dict[Any, str] = {}
        #: Rewrites of names, for join conditions.
        self.sides: dict[str, dict[str, str]] = {}

    def val(self, c: Column, **more: Any) -> Val:
        return Val(c, self.frame, **more)

    def hoist(self, c: Column) -> str:
        """Adds the expression as a hidden column and returns its name."""
        name = fresh()
        self.frame = self.frame.with_df(self.frame.df.withColumn(name, c))
        return name

    def reframe(self, frame: Frame) -> None:
        """Puts another frame, which has all columns of the old one, in its place."""
        self.frame = frame

    def rows(self) -> Scope:
        """The scope of an aggregate's arguments: the input's rows."""
        return self if not self.aggregating else _RowScope(self)

    # Dispatch.
    def lower(self, e: Any) -> Val:
        if isinstance(e, Named):
            return self.lower(e.expr)
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def col(self, e: Any) -> Column:
        return self.lower(e).col

    def constant(self, e: Any) -> Any:
        """The Python value of a constant expression."""
        v = self.lower(e)
        if v.is_const:
            return v.value
        got = self.lowering.spark.range(1).select(v.col.alias("x")).first()
        return got["x"]

    def _lit(self, e: Lit) -> Val:
        if e.type == "dynamic":
            c, json = K.dynamic_lit(e.value)
            return self.val(c, json=json, value=e.value)
        return self.val(K.literal(e.value, e.type), type=K.SPARK[e.type], value=e.value)

    def _name(self, e: Name) -> Val:
        fields = self.frame.fields
        if e.id in fields:
            v = self.val(quoted(e.id), type=fields[e.id].dataType, json=self.frame.is_json(e.id))
            micros = fields[e.id].metadata.get(MICROS)
            v.micros = quoted(micros) if micros in fields else None
            return v
        if e.id in self.env:
            return self._bound(e.id)
        raise QueryError(f"no column or binding {e.id!r}; columns: {', '.join(self.frame.columns)}")

    def _bound(self, name: str) -> Val:
        b = self.env[name]
        if isinstance(b, Val):
            return Val(b.col, self.frame, b._type, b.json, b.value)
        if b[0] == "scalar":
            inner = Scope(self.lowering, self.frame, b[2], self.aggregating)
            return inner.lower(b[1])
        if b[0] == "function" and not b[1].params:
            return self._user(name, [])
        raise QueryError(f"{name!r} is a table, not a value")

    def _star(self, e: Star) -> Val:
        raise QueryError("* cannot be used here")

    def _query(self, e: Query) -> Val:
        return self._toscalar(e)

    def _datatable(self, e: DataTable) -> Val:
        return self._toscalar(e)

    def _op(self, e: Op) -> Val:
        return self._toscalar(e)

    def _toscalar(self, q: Any) -> Val:
        f = self.lowering.query(q, self.env)
        first = f.columns[0]
        return self.val(f.df.select(quoted(first)).limit(1).scalar(), type=f.fields[first].dataType, json=f.is_json(first))

    # Navigation.
    def _path(self, e: Path) -> Val:
        if isinstance(e.base, Name) and e.base.id in self.sides:
            return self._name(Name(self.sides[e.base.id][e.key]))
        if isinstance(e.base, Name) and e.base.id in ("$left", "$right"):
            return self._name(Name(e.key))
        base = self.lower(e.base)
        if isinstance(base.type, T.StructType):
            return self.val(base.col.getField(e.key))
        if isinstance(base.type, T.MapType):
            return self.val(F.try_element_at(base.col, F.lit(e.key)))
        return self.val(F.get_json_object(base.col, "$." + _json_key(e.key)), type=T.StringType(), json=True)

    def _index(self, e: Index) -> Val:
        base, key = self.lower(e.base), self.lower(e.key)
        if base.is_array:
            i = key.int
            if key.is_const and int(key.value) >= 0:
                return self.val(F.get(base.col, F.lit(int(key.value))))
            return self.val(F.get(base.col, F.when(i < 0, F.size(base.col) + i).otherwise(i)))
        if isinstance(base.type, T.StructType):
            return self.val(base.col.getField(str(key.const("the field"))))
        if isinstance(base.type, T.MapType):
            return self.val(F.try_element_at(base.col, key.col))
        if key.is_const and isinstance(key.value, str):
            return self.val(F.get_json_object(base.col, "$." + _json_key(key.value)), type=T.StringType(), json=True)
        if key.is_const and key.value >= 0:
            return self.val(F.get_json_object(base.col, f"$[{int(key.value)}]"), type=T.StringType(), json=True)
        if key.is_string:
            return self.val(F.try_element_at(F.from_json(base.col, "map<string,string>"), key.s), type=T.StringType(), json=True)
        items = F.from_json(base.col, "array<string>")
        i = key.int
        return self.val(F.get(items, F.when(i < 0, F.size(items) + i).otherwise(i)), type=T.StringType(), json=True)

    # Operators.
    def _un(self, e: Un) -> Val:
        x = self.lower(e.x)
        if K.is_span(x.type):
            return self.val(-x.col if e.op == "-" else x.col)
        return self.val(-x.num if e.op == "-" else x.num)

    def _bin(self, e: Bin) -> Val:
        if e.op in ("and", "or"):
            a, b = self.lower(e.left).bool, self.lower(e.right).bool
            return self.val(a & b if e.op == "and" else a | b, type=T.BooleanType())
        if isinstance(e.left, Star):
            return self._any_column(e)
        if e.op in ("in", "!in", "in~", "!in~"):
            return self._in(e)
        if e.op in ("has_any", "has_all", "has_any~", "has_all~"):
            return self._has_list(e)
        if e.op == ":":
            return self.val(self.term(self.lower(e.left).s, e.right.value, False))
        a, b = self.lower(e.left), self.lower(e.right)
        if e.op in ("+", "-", "*", "/", "%"):
            return self._arithmetic(e.op, a, b)
        if e.op in ("==", "!=", "<", ">", "<=", ">="):
            return self.val(compare(e.op, a, b), type=T.BooleanType())
        return self.val(self._text_operator(e.op, a, b), type=T.BooleanType())

    def _any_column(self, e: Bin) -> Val:
        """``* op x``: some column; negated operators: all columns."""
        negated = e.op.startswith("!")
        out = None
        for name in self.frame.columns:
            a = self._name(Name(name))
            one = self._bin(Bin(e.op, Call("tostring", [Name(name)]) if not a.is_string else Name(name), e.right)).col
            out = one if out is None else (out & one if negated else out | one)
        return self.val(out, type=T.BooleanType())

    def _arithmetic(self, op: str, a: Val, b: Val) -> Val:
        ta, tb = a.type, b.type
        if op == "+" and K.is_time(tb) and K.is_span(ta):
            a, b, ta, tb = b, a, tb, ta
        if K.is_time(ta):
            if K.is_time(tb) and op == "-":
                return self.val((a.t - b.t).cast(K.SPAN), type=K.SPAN)
            if K.is_span(tb) and op in "+-":
                return self.val(a.t + b.col if op == "+" else a.t - b.col, type=T.TimestampNTZType())
            if K.is_number(tb) and op in "+-":
                days = b.span
                return self.val(a.t + days if op == "+" else a.t - days, type=T.TimestampNTZType())
            if K.is_span(tb) and op == "/":
                return self.val((K.micros(a.t) + F.lit(K.EPOCH)).cast("double") / K.span_micros(b.col))
            if op == "-" and b.is_string:
                return self.val((a.t - b.t).cast(K.SPAN), type=K.SPAN)
        if K.is_span(ta):
            if K.is_span(tb):
                if op in "+-":
                    return self.val((a.col + b.col if op == "+" else a.col - b.col).cast(K.SPAN), type=K.SPAN)
                x, y = (K.span_micros(v.col) if v.micros is None else v.micros for v in (a, b))
                if op == "/":
                    real = real_divide(x.cast("double"), y.cast("double"))
                    whole = F.when(F.abs(real) < float(1 << 63), F.call_function("div", x, F.nullif(y, F.lit(0).cast("long"))))
                    return Val(real, self.frame, T.DoubleType(), whole=whole)
                return self.val(K.micros_span(F.pmod(x, F.nullif(F.abs(y), F.lit(0).cast("long")))))
            if op in "*/":
                n = b.num.cast("double")
                us = K.span_micros(a.col).cast("double")
                return self.val(K.micros_span((us * n if op == "*" else us / F.nullif(n, F.lit(0.0))).cast("long")), type=K.SPAN)
        if K.is_span(tb) and op == "*":
            return self._arithmetic("*", b, a)
        x, y = a.num, b.num
        whole = K.is_integral(_numeric(a)) and K.is_integral(_numeric(b))
        if op == "+":
            return self.val(x + y)
        if op == "-":
            return self.val(x - y)
        if op == "*":
            return self.val(x * y)
        if op == "/":
            if whole:
                return self.val(F.call_function("div", x, F.nullif(y, F.lit(0))), type=T.LongType())
            return self.val(real_divide(x.cast("double"), y.cast("double")), type=T.DoubleType())
        return self.val(F.pmod(x, F.nullif(F.abs(y), F.lit(0))))

    def _text_operator(self, op: str, a: Val, b: Val) -> Column:
        if op in ("=~", "!~"):
            x, y = F.upper(a.s), F.upper(b.s)
            return x == y if op == "=~" else ~x.eqNullSafe(y)
        if op == "matches regex":
            return F.rlike(a.s, F.lit(_java(b.value)) if b.is_const else b.s)
        negated = op.startswith("!") or op == "notcontains"
        name = op.lstrip("!").replace("notcontains", "contains")
        exact = name.endswith("_cs")
        name = name.removesuffix("_cs")
        x, y = (a.s, b.s) if exact else (F.lower(a.s), F.lit(b.value.lower()) if b.is_const and isinstance(b.value, str) else F.lower(b.s))
        if name in ("contains", "startswith", "endswith"):
            out = getattr(F, name)(x, y)
        else:
            before, after = {"has": (_BEFORE, _AFTER), "hasprefix": (_BEFORE, ""), "hassuffix": ("", _AFTER)}[name]
            quoted_term = quote_regex(b if exact or not b.is_const else Val(y, self.frame, value=b.value.lower()))
            quoted_term = quoted_term if exact or b.is_const else F.lower(quoted_term)
            # The plain search first: it is cheap and nearly always says no.
            out = F.contains(x, y) & F.rlike(x, F.concat(F.lit("(?u)" + before), quoted_term, F.lit(after)))
        return ~F.coalesce(out, F.lit(False)) if negated else out

    def term(self, x: Column, pattern: str, exact: bool) -> Column:
        """Does a term of the text match, where ``*`` at either end lets it go on?"""
        if not pattern.strip("*"):
            return x.isNotNull()
        start, end = pattern.startswith("*"), pattern.endswith("*")
        inner = [re.escape(p) for p in pattern.strip("*").split("*")]
        body = ".*".join(re.sub(r"\\(?=[^\W_]|[\s,;:'\"<>=@!%&~`#/_-])", "", p) for p in inner)
        if not exact:
            x, body = F.lower(x), body.lower()
        found = F.rlike(x, F.lit("(?us)" + ("" if start else _BEFORE) + body + ("" if end else _AFTER)))
        plain = pattern.strip("*")
        return found if "*" in plain else F.contains(x, F.lit(plain if exact else plain.lower())) & found

    def _in(self, e: Bin) -> Val:
        negated, fold = e.op.startswith("!"), e.op.endswith("~")
        x = self.lower(e.left)
        items = e.right.items
        if len(items) == 1 and self.lowering.is_table(items[0], self.env):
            f = self.lowering.query(items[0], self.env)
            first = f.columns[0]
            values = f.df.agg(F.collect_set(quoted(first))).scalar()
            found = F.array_contains(F.transform(values, lambda v: F.upper(v)), F.upper(x.s)) if fold else F.array_contains(values, x.col.cast(f.fields[first].dataType))
            found = F.coalesce(found, F.lit(False))
            return self.val(~found if negated else found, type=T.BooleanType())
        vals = []
        for i in items:
            v = self.lower(i)
            vals += [self._lit(Lit(y, _kind(y))) for y in v.value] if v.is_const and isinstance(v.value, list) else [v]
        lists = [v for v in vals if v.is_array or v.json and not v.is_const]
        vals = [v for v in vals if not (v.is_array or v.json and not v.is_const)]
        found = F.lit(False)
        if vals:
            if fold:
                found = F.upper(x.s).isin(*[F.upper(v.s) for v in vals])
            elif all(v.is_const for v in vals) and (x.is_string and not x.json) and all(isinstance(v.value, str) for v in vals):
                found = x.col.isin(*[v.value for v in vals])
            else:
                found = None
                for v in vals:
                    one = compare("==", x, v)
                    found = one if found is None else found | one
        for v in lists:
            found = found | F.array_contains(v.arr, x.s if not v.is_array or isinstance(v.type.elementType, T.StringType) else x.col.cast(v.type.elementType))
        found = F.coalesce(found, F.lit(False))
        return self.val(~found if negated else found, type=T.BooleanType())

    def _has_list(self, e: Bin) -> Val:
        x = self.lower(e.left)
        terms: list[Val] = []
        for i in e.right.items if isinstance(e.right, Items) else [e.right]:
            v = self.lower(i)
            if v.is_const and isinstance(v.value, list):
                terms += [self._lit(Lit(str(y), "string")) for y in v.value]
            elif v.is_array or v.json:
                low = F.lower(x.s)
                hits = F.transform(v.arr, lambda t: F.rlike(low, F.concat(F.lit("(?u)" + _BEFORE), F.regexp_replace(F.lower(t), r"([\\.\[\]{}()*+?^$|])", r"\\$1"), F.lit(_AFTER))))
                return self.val(F.exists(hits, lambda h: h) if e.op.startswith("has_any") else F.forall(hits, lambda h: h), type=T.BooleanType())
            else:
                terms.append(v)
        out = None
        for t in terms:
            one = self._text_operator("has", x, t)
            out = one if out is None else (out | one if e.op.startswith("has_any") else out & one)
        return self.val(F.lit(False) if out is None else out, type=T.BooleanType())

    # Calls.
    def _call(self, e: Call) -> Val:
        name = e.name
        if name in self.env:
            return self._user(name, e.args)
        if name in ("between", "!between"):
            x, a, b = (self.lower(v) for v in e.args)
            if K.is_time(x.type) and K.is_span(b.type):
                b = self._arithmetic("+", a, b)
            inside = compare(">=", x, a) & compare("<=", x, b)
            return self.val(inside if name == "between" else ~inside, type=T.BooleanType())
        if name == "toscalar":
            return self._toscalar(e.args[0])
        if name in ("column_ifexists", "columnifexists"):
            column = self.constant(e.args[0])
            return self._name(Name(column)) if column in self.frame.fields else self.lower(e.args[1])
        if name == "bag_pack_columns":
            return self._call(Call("bag_pack", [y for a in e.args for y in (Lit(a.id, "string"), a)]))
        if name == "pack_all":
            return self._call(Call("bag_pack", [y for c in self.frame.columns for y in (Lit(c, "string"), Name(c))]))
        if name == "materialize":
            return self._toscalar(e.args[0])
        if name in _WINDOWS:
            return self._window(name, e.args)
        if self.aggregating and name in AGGREGATES:
            scope = self.rows()
            args = [scope.lower(a) for a in e.args]
            out = AGGREGATES[name](self, *args)
            return out if isinstance(out, Val) else self.val(out)
        if name in _TEXT_CALLS and len(e.args) == 2:
            return self._bin(Bin(name, *e.args))
        if name in FUNCTIONS:
            return build(name, self.frame, [self.lower(a) for a in e.args])
        if name in AGGREGATES:
            raise QueryError(f"{name} is an aggregate: use it in summarize")
        raise QueryError(f"unknown function {name!r}")

    def _user(self, name: str, args: list) -> Val:
        b = self.env[name]
        if isinstance(b, Val) or b[0] != "function":
            raise QueryError(f"{name!r} is not a function")
        f: Function = b[1]
        env = self.lowering.arguments(f, args, b[2], self)
        for let in f.statements:
            env = self.lowering.bind(let, env)
        if self.lowering.is_table(f.body, env):
            return Scope(self.lowering, self.frame, env)._toscalar(f.body)
        inner = Scope(self.lowering, self.frame, env, self.aggregating)
        out = inner.lower(f.body)
        self.frame, self.windowed = inner.frame, self.windowed or inner.windowed
        return out

    # Windows over the serialized order.
    def _argument(self, e: Any) -> Val:
        """An argument of a window function; if it has a window itself, it becomes a column first."""
        before, self.windowed = self.windowed, False
        v = self.lower(e)
        if self.windowed:
            v = Val(quoted(self.hoist(v.col)), self.frame, None, v.json)
        self.windowed = before
        return v

    def _window(self, name: str, args: list) -> Val:
        restart_at = {"row_number": 1, "row_cumsum": 1, "row_rank_dense": 1, "row_rank_min": 1}.get(name)
        if not self.frame.keys and not self.frame.df.isStreaming:
            out = self._spread(name, args, restart_at)
            if out is not None:
                self.windowed = True
                return out
        values = [self._argument(a) for a in (args[:restart_at] if restart_at is not None else args)]
        extra: list[Column] = []
        if restart_at is not None and len(args) > restart_at:
            p = self._argument(args[restart_at])
            group = F.sum(F.coalesce(p.bool, F.lit(False)).cast("int")).over(self._running())
            extra = [quoted(self.hoist(group))]
        out = self._window_column(name, values, extra)
        self.windowed = True
        return out if isinstance(out, Val) else self.val(out)

    def _spread(self, name: str, args: list, restart_at: int | None) -> Val | None:
        """A window function over one global order, computed in parts; None for a shift that is too long."""
        if name in ("prev", "next"):
            n = int(self._argument(args[1]).const("the offset")) if len(args) > 1 else 1
            if abs(n) > serial.REACH:
                return None
        if not self.frame.order:
            self.frame.window()  # warns
        self.reframe(serial.spread(self.frame))

        def once(f: Any, key: Any, *inputs: Any) -> Column:
            # A function of random numbers is another one each time it is written.
            if key not in self.made or any(w in repr(key) for w in ("rand", "guid", "uuid")):
                frame, self.made[key] = f(self.frame, *inputs)
                self.reframe(frame)
            return quoted(self.made[key])

        shift = lambda v, e, n: once(serial.shifted, ("shift", repr(e), n), v.col, n)
        values = [self._argument(a) for a in (args[:restart_at] if restart_at is not None else args)]
        first = args[0] if args else None
        if name in ("prev", "next"):
            v = values[0]
            row = shift(v, first, n if name == "prev" else -n)
            return self.val(F.when(row.isNotNull(), row["v"]).otherwise(values[2].col) if len(values) > 2 else row["v"], json=v.json)
        restart, where = None, ""
        if restart_at is not None and len(args) > restart_at:
            restart, where = F.coalesce(self._argument(args[restart_at]).bool, F.lit(False)), repr(args[restart_at])
        number = lambda: once(serial.running, ("number", where), F.lit(1).cast("long"), restart)
        if name == "row_number":
            return self.val(number() + (values[0].long if values else F.lit(1)) - 1)
        v = values[0]
        if name == "row_cumsum":
            span = K.is_span(v.type)
            total = once(serial.running, ("sum", repr(first), where), v.col if span else v.num, restart)
            return self.val(F.coalesce(total, K.span_lit(0) if span else F.lit(0)))
        before = shift(v, first, 1)
        if name == "row_window_session":
            late = v.col > before["v"] + (values[-1] if len(values) == 2 else values[2]).col
            if len(values) > 2:
                late = late | (v.col - before["v"] > values[1].col)
            new = F.when(F.coalesce(late, F.lit(False)), 1).otherwise(0)
            return self.val(once(serial.running, ("session", repr(args)), new).cast("long"))
        changed = before.isNull() | ~v.col.eqNullSafe(before["v"])
        if restart is not None:
            changed = changed | restart
        if name == "row_rank_dense":
            return self.val(once(serial.running, ("dense", repr(first), where), changed.cast("int"), restart).cast("long"))
        row = number()
        return self.val(once(lambda f, x: serial.running(f, x, last=True), ("min", repr(first), where), F.when(changed, row)))

    def _running(self, *extra: Column) -> Any:
        from pyspark.sql import Window

        return self.frame.window(*extra).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def _window_column(self, name: str, v: list[Val], extra: list[Column]) -> Any:
        w = self.frame.window(*extra)
        if name == "row_number":
            start = v[0].long if v else F.lit(1)
            return F.row_number().over(w).cast("long") + start - 1
        if name in ("prev", "next"):
            n = int(v[1].const("the offset")) if len(v) > 1 else 1
            c = (F.lag if name == "prev" else F.lead)(v[0].col, n).over(w)
            if len(v) > 2:
                row = F.row_number().over(w) if name == "prev" else F.count(F.lit(1)).over(self._following(*extra))
                c = F.when(row <= n, v[2].col).otherwise(c)
            return self.val(c, json=v[0].json)
        if name == "row_cumsum":
            return F.coalesce(F.sum(v[0].num if not K.is_span(v[0].type) else v[0].col).over(self._running(*extra)), F.lit(0) if not K.is_span(v[0].type) else K.span_lit(0))
        first = F.row_number().over(w) == 1
        if name == "row_window_session":
            gap = v[-1] if len(v) == 2 else v[2]
            late = v[0].col > F.lag(v[0].col).over(w) + gap.col
            if len(v) > 2:
                within = v[1]
                late = late | (v[0].col - F.lag(v[0].col).over(w) > within.col)
            new = quoted(self.hoist(F.when(F.coalesce(late, F.lit(False)) & ~first, 1).otherwise(0)))
            return F.sum(new).over(self._running(*extra)).cast("long")
        changed = quoted(self.hoist((first | ~v[0].col.eqNullSafe(F.lag(v[0].col).over(w))).cast("int")))
        rank = F.sum(changed).over(self._running(*extra)).cast("long")
        if name == "row_rank_dense":
            return rank
        row, group = quoted(self.hoist(F.row_number().over(self.frame.window(*extra)).cast("long"))), quoted(self.hoist(rank))
        from pyspark.sql import Window

        return F.min(row).over(Window.partitionBy(*[quoted(k) for k in self.frame.keys], *extra, group))

    def _following(self, *extra: Column) -> Any:
        from pyspark.sql import Window

        return self.frame.window(*extra).rowsBetween(Window.currentRow, Window.unboundedFollowing)


class _RowScope(Scope):
    """Arguments of aggregates; hidden columns go to the aggregating scope's frame."""

    def __init__(self, outer: Scope):
        super().__init__(outer.lowering, outer.frame, outer.env)
        self.outer = outer

    def hoist(self, c: Column) -> str:
        name = self.outer.hoist(c)
        self.frame = self.outer.frame
        return name

    def reframe(self, frame: Frame) -> None:
        self.outer.reframe(frame)
        self.frame = frame

    def lower(self, e: Any) -> Val:
        self.frame = self.outer.frame
        before, self.windowed = self.windowed, False
        v = super().lower(e)
        if self.windowed:
            # A window cannot stand inside an aggregate.
            v = Val(quoted(self.hoist(v.col)), self.frame, None, v.json)
        self.windowed = before
        return v


def _java(pattern: str) -> str:
    return pattern.replace("(?P<", "(?<")


def _kind(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "long" if isinstance(v, int) else "real" if isinstance(v, float) else "string" if isinstance(v, str) else "dynamic"


def _json_key(key: str) -> str:
    return key if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", key) else "['" + key.replace("'", "\\'") + "']"


def _numeric(v: Val) -> T.DataType:
    return T.DoubleType() if v.is_string or isinstance(v.type, T.NullType) else T.IntegerType() if isinstance(v.type, T.BooleanType) else v.type


def real_divide(x: Column, y: Column) -> Column:
    """Division of doubles with infinities and NaN."""
    by_zero = F.when(x.isNull(), F.lit(None).cast("double")).when(x > 0, float("inf")).when(x < 0, float("-inf")).otherwise(float("nan"))
    return F.when(y == 0, by_zero).otherwise(x / F.nullif(y, F.lit(0.0)))


def compare(op: str, a: Val, b: Val) -> Column:
    """Comparison; ``!=`` holds between a null and a value.  JSON text is compared as the other side's type."""
    ta, tb = a.type, b.type
    x, y = a.col, b.col
    if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
        pass
    elif K.is_time(ta) or K.is_time(tb):
        x, y = a.t, b.t
    elif K.is_span(ta) or K.is_span(tb):
        x, y = a.span, b.span
    elif K.is_number(ta) != K.is_number(tb):
        x, y = a.num, b.num
    elif isinstance(ta, T.BooleanType) != isinstance(tb, T.BooleanType):
        x, y = a.bool, b.bool
    elif a.is_array != b.is_array:
        x, y = a.json_text, b.json_text
    if op == "==":
        return x == y
    if op == "!=":
        return ~x.eqNullSafe(y)
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]
