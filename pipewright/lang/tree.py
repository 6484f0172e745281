"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Lit:
    """A constant; ``type`` is the language's type name, a null has the value None."""

    value: Any
    type: str


@dataclass
class Name:
    id: str


@dataclass
class Star:
    pass


@dataclass
class Path:
    """``base.key``"""

    base: Any
    key: str


@dataclass
class Index:
    """``base[key]``"""

    base: Any
    key: Any


@dataclass
class Call:
    name: str
    args: list


@dataclass
class Bin:
    op: str
    left: Any
    right: Any


@dataclass
class Un:
    op: str
    x: Any


@dataclass
class Items:
    """The parenthesised right side of ``in`` and the like."""

    items: list


@dataclass
class Named:
    """``name = expr`` or ``(a, b) = expr``."""

    names: list[str]
    expr: Any


@dataclass
class Query:
    """A source followed by operators."""

    source: Any
    ops: list[Op] = field(default_factory=list)


@dataclass
class Op:
    kind: str
    args: dict[str, Any]

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["args"][name]
        except KeyError:
            raise AttributeError(name) from None


@dataclass
class DataTable:
    columns: list[tuple[str, str]]
    values: list


@dataclass
class ExternalData:
    columns: list[tuple[str, str]]
    uris: list[str]
    options: dict[str, Any]


@dataclass
class Function:
    """``params``: (name, type or column list, default)."""

    params: list[tuple[str, Any, Any]]
    body: Any
    statements: list = field(default_factory=list)


@dataclass
class Let:
    name: str
    value: Any


@dataclass
class Script:
    lets: list[Let]
    query: Any
