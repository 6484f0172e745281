"""Names of result columns that the query does not name."""

from __future__ import annotations

from typing import Any

from pipewright.functions.aggregates import PREFIX
from pipewright.lang.tree import Call, Index, Lit, Name, Path

#: Functions whose result is named like their argument.
_KEEPS = {"bin", "floor", "round", "abs", "bin_at", "startofday", "startofweek", "startofmonth", "startofyear", "endofday", "endofweek", "endofmonth", "endofyear", "tostring", "toint", "tolong", "toreal", "todouble", "tofloat", "tobool", "toboolean", "todecimal", "todatetime", "totimespan", "toguid", "todynamic", "parse_json", "string", "int", "long", "real", "double", "bool", "ceiling"}
_PATH_KEEPS = {n for n in _KEEPS if n.startswith("to") or n == "parse_json"}


def simple(e: Any) -> str | None:
    """The name that a reference has by itself: ``a``, ``a_b`` for a path."""
    if isinstance(e, Name):
        return e.id
    if isinstance(e, Path):
        base = simple(e.base)
        return f"{base}_{e.key}" if base else None
    if isinstance(e, Index) and isinstance(e.key, Lit) and isinstance(e.key.value, (str, int)):
        base = simple(e.base)
        return f"{base}_{e.key.value}" if base else None
    return None


def of_expression(e: Any) -> str | None:
    if isinstance(e, Call) and e.name in _PATH_KEEPS and e.args:
        return simple(e.args[0])
    return simple(e)


def of_key(e: Any) -> str | None:
    if isinstance(e, Call) and e.name in _KEEPS and e.args:
        return of_key(e.args[0])
    return simple(e)


def of_aggregate(e: Any) -> str | None:
    if not isinstance(e, Call):
        return None
    arg = simple(e.args[0]) if e.args else None
    if e.name in ("take_any", "any"):
        return arg
    if e.name in ("percentile", "percentilew") and arg:
        p = e.args[-1]
        return f"{e.name}_{arg}_{number(p)}"
    return f"{PREFIX.get(e.name, e.name)}_{arg or ''}"


def number(e: Any) -> str:
    v = e.value if isinstance(e, Lit) else ""
    return str(v).replace(".", "_")


class Namer:
    """Gives unnamed columns ``Column1`` and so on, and repeated names the lowest free number."""

    def __init__(self, taken: list[str] | None = None):
        self.taken = set(taken or [])
        self.n = 0

    def free(self, name: str | None, stem: str = "Column") -> str:
        if name is None:
            while True:
                self.n += 1
                name = f"{stem}{self.n}"
                if name not in self.taken:
                    break
        base, k = name, 0
        while name in self.taken:
            k += 1
            name = f"{base}{k}"
        self.taken.add(name)
        return name
