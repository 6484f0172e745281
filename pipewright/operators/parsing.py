"""parse, parse-where, parse-kv and search."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import QueryError
from pipewright.functions.strings import java_regex
from pipewright.lang.tree import Bin, Call, Lit, Name
from pipewright.operators.base import operator
from pipewright.plans.expressions import Scope
from pipewright.plans.frame import Frame, fresh, quoted

_SHAPES = {"long": r"(-?\d+)", "int": r"(-?\d+)", "real": r"(-?\d+\.?\d*)", "double": r"(-?\d+\.?\d*)", "decimal": r"(-?\d+\.?\d*)", "bool": "(true|false)", "boolean": "(true|false)"}


def _quote(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", text)


def pattern(parts: list, regex: bool, relaxed: bool) -> tuple[str, list[tuple[str, str]]]:
    """The regular expression of a parse pattern and its columns."""
    out, columns = "", []
    for k, part in enumerate(parts):
        if part[0] == "star":
            out += ".*?"
        elif part[0] == "text":
            out += java_regex(part[1]) if regex else _quote(part[1])
        else:
            columns.append((part[1], part[2]))
            last = not any(p[0] in ("text", "column") for p in parts[k + 1 :])
            shape = None if relaxed else _SHAPES.get(part[2])
            out += shape or ("(.*)" if regex or last else "(.*?)")
    return "(?s)" + out, columns


def _parsed(lowering, frame, op, env, strict: bool) -> Frame:
    kind = op.options.get("kind", "simple")
    expression, columns = pattern(op.parts, kind == "regex", kind == "relaxed")
    scope = Scope(lowering, frame, env)
    # The text once, then every group from it.
    source = fresh("p")
    df = scope.frame.df.withColumn(source, scope.lower(op.expr).s)
    made = {}
    groups = []
    # Groups inside a column's own pattern are counted too.
    at = 0
    for name, kind_of in columns:
        at += 1
        raw = F.regexp_extract(quoted(source), expression, at)
        groups.append(raw)
        made[name] = (raw if kind_of == "string" else K.cast(raw, T.StringType(), kind_of)).alias(name)
    if strict:
        condition = None
        for g in groups:
            condition = g != "" if condition is None else condition & (g != "")
        if condition is not None:
            df = df.where(condition)
    cols = [made.get(c, quoted(c)) for c in frame.columns] + [c for n, c in made.items() if n not in frame.columns]
    out = frame.with_df(df).select_visible(cols, set(frame.columns) - set(made))
    return out.with_df(out.df.drop(source))


@operator("parse")
def parse(lowering, frame, op, env):
    return _parsed(lowering, frame, op, env, False)


@operator("parse-where")
def parse_where(lowering, frame, op, env):
    return _parsed(lowering, frame, op, env, True)


@operator("parse-kv")
def parse_kv(lowering, frame, op, env):
    """Values by key; they run to the next pair delimiter, or to the closing quote."""
    pair, kv = op.options.get("pair_delimiter", ","), op.options.get("kv_delimiter", "=")
    quote = op.options.get("quote")
    scope = Scope(lowering, frame, env)
    source = fresh("kv")
    df = scope.frame.df.withColumn(source, scope.lower(op.expr).s)
    inside = re.sub(r"([\\\]^\[&-])", r"\\\1", pair)
    cols = []
    names = [n for n, _ in op.columns]
    for name, kind in op.columns:
        head = rf"(?:^|{_quote(pair)})\s*{_quote(name)}\s*{_quote(kv)}\s*"
        raw = F.trim(F.regexp_extract(quoted(source), rf"{head}([^{inside}]*)", 1))
        if quote:
            q = _quote(quote)
            held = rf"{head}{q}([^{re.sub(r'([\\\]^\[&-])', r'\\\1', quote)}]*){q}"
            raw = F.when(F.rlike(quoted(source), F.lit(held)), F.regexp_extract(quoted(source), held, 1)).otherwise(raw)
        cols.append((raw if kind == "string" else K.cast(raw, T.StringType(), kind)).alias(name))
    out = frame.with_df(df).select_visible([quoted(c) for c in frame.columns if c not in names] + cols, set(frame.columns) - set(names))
    return out.with_df(out.df.drop(source))


@operator("search")
def search(lowering, frame, op, env):
    """Rows with the terms in any column, under a first column ``$table``."""
    exact = op.options.get("kind") == "case_sensitive"
    if frame is not None:
        frames = [(frame.name or "", frame)]
    else:
        names = op.tables or lowering.names()
        if not names:
            raise QueryError("search: there are no tables")
        frames = [(n, lowering.table(n, env)) for n in names]
    parts = []
    for name, f in frames:
        scope = Scope(lowering, f, env)
        condition = _search(scope, op.predicate, exact)
        if condition is None:
            continue
        cols = [F.lit(name).alias("$table"), *[quoted(c) for c in f.columns]]
        parts.append((name, f.with_df(scope.frame.df.where(condition)).select_visible(cols, set(f.columns))))
    if not parts:
        raise QueryError("search: no table has the columns")
    out = parts[0][1]
    for _, p in parts[1:]:
        out = Frame(out.result().unionByName(p.result(), allowMissingColumns=True))
    return out


def _search(scope: Scope, e, exact: bool):
    if isinstance(e, Bin) and e.op in ("and", "or"):
        a, b = _search(scope, e.left, exact), _search(scope, e.right, exact)
        if a is None or b is None:
            return None
        return a & b if e.op == "and" else a | b
    if isinstance(e, Call) and e.name == "not":
        c = _search(scope, e.args[0], exact)
        return None if c is None else ~F.coalesce(c, F.lit(False))
    if isinstance(e, Lit) and isinstance(e.value, str):
        out = None
        for c in scope.frame.columns:
            one = scope.term(scope.lower(Name(c)).s, e.value, exact)
            out = one if out is None else out | one
        return F.coalesce(out, F.lit(False))
    if isinstance(e, Bin) and e.op == ":" and isinstance(e.left, Name):
        if e.left.id not in scope.frame.columns:
            return None
        return scope.term(scope.lower(e.left).s, str(e.right.value), exact)
    if isinstance(e, Bin) and isinstance(e.left, Name) and e.left.id not in scope.frame.columns:
        return None
    return scope.lower(e).bool
