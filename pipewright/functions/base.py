"""What scalar functions are made of: typed values and the registry."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K

MISSING = object()


class QueryError(ValueError):
    """A query that parses but has no meaning over its input."""


class Val:
    """A column expression over ``frame`` with its type (found by the analyzer when asked for), whether it is JSON
    text, and its value if it is a constant.  ``micros``: a timespan's microseconds as a decimal, where they may not fit
    the timespan.  ``whole``: a real's whole part, where it is known to more digits than the real has."""

    __slots__ = ("col", "frame", "_type", "json", "value", "micros", "whole")

    def __init__(self, col: Column, frame: Any, type: T.DataType | None = None, json: bool = False, value: Any = MISSING, micros: Column | None = None, whole: Column | None = None):
        self.col, self.frame, self._type, self.json, self.value, self.micros, self.whole = col, frame, type, json, value, micros, whole

    @property
    def type(self) -> T.DataType:
        if self._type is None:
            self._type = self.frame.type_of(self.col)
        return self._type

    @property
    def is_const(self) -> bool:
        return self.value is not MISSING

    @property
    def is_string(self) -> bool:
        return isinstance(self.type, T.StringType)

    @property
    def is_array(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def s(self) -> Column:
        """As text; nulls of strings stay null."""
        return self.col if self.is_string else K.text(self.col, self.type)

    @property
    def num(self) -> Column:
        """As a number: JSON text and strings become doubles."""
        if self.is_string or isinstance(self.type, T.NullType):
            return self.col.try_cast("double")
        if isinstance(self.type, T.BooleanType):
            return self.col.cast("int")
        return self.col

    @property
    def real(self) -> Column:
        return self.num.cast("double") if not K.is_span(self.type) else self.col

    @property
    def long(self) -> Column:
        return self.num.try_cast("long") if self.whole is None else self.whole

    @property
    def int(self) -> Column:
        return self.num.try_cast("int") if self.whole is None else self.whole.try_cast("int")

    @property
    def bool(self) -> Column:
        return self.col if isinstance(self.type, T.BooleanType) else K.cast(self.col, self.type, "bool")

    @property
    def t(self) -> Column:
        return self.col if isinstance(self.type, T.TimestampNTZType) else K.cast(self.col, self.type, "datetime")

    @property
    def span(self) -> Column:
        return self.col if K.is_span(self.type) else K.cast(self.col, self.type, "timespan")

    @property
    def arr(self) -> Column:
        """As an array: JSON text is parsed into an array of strings; null for anything else."""
        return self.col if self.is_array else F.from_json(self.s, "array<string>")

    @property
    def reals(self) -> Column:
        if self.is_array and isinstance(self.type.elementType, T.DoubleType):
            return self.col
        return F.transform(self.arr, lambda x: x.try_cast("double"))

    @property
    def json_text(self) -> Column:
        """As JSON text."""
        if self.json or self.is_string:
            return self.col
        return F.to_json(self.col) if isinstance(self.type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else K.text(self.col, self.type)

    def const(self, what: str) -> Any:
        if not self.is_const:
            raise QueryError(f"{what} must be a constant")
        return self.value


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` evaluated once for each row, however often ``use`` has it inside lambdas."""
    return F.get(F.transform(F.array(c), use), 0)


Builder = Callable[..., Any]
#: name -> (least arguments, most arguments or None, builder)
FUNCTIONS: dict[str, tuple[int, int | None, Builder]] = {}


def function(names: str, least: int, most: int | None = -1) -> Callable[[Builder], Builder]:
    """Registers a builder ``f(frame, *values)`` under all of ``names``; ``most`` None: any number."""

    def add(f: Builder) -> Builder:
        for n in names.split():
            FUNCTIONS[n] = (least, least if most == -1 else most, f)
        return f

    return add


def build(name: str, frame: Any, args: list[Val]) -> Val:
    """Calls the registered function."""
    if name not in FUNCTIONS:
        raise QueryError(f"unknown function {name!r}")
    least, most, f = FUNCTIONS[name]
    if len(args) < least or most is not None and len(args) > most:
        raise QueryError(f"{name} takes {least}{'' if most == least else ' or more' if most is None else f' to {most}'} arguments, not {len(args)}")
    out = f(frame, *args)
    return out if isinstance(out, Val) else Val(out, frame)


def common(values: list[Val]) -> list[Column]:
    """The values' columns brought to one type, as branches of a conditional need it."""
    types = [v.type for v in values if not isinstance(v.type, T.NullType) and not (v.is_const and v.value is None)]
    if not types or all(t == types[0] for t in types):
        return [v.col.cast(types[0]) if types and isinstance(v.type, T.NullType) else v.col for v in values]
    if all(K.is_number(t) for t in types):
        return [v.col for v in values]
    if any(isinstance(t, T.StringType) for t in types):
        return [F.lit(None).cast("string") if isinstance(v.type, T.NullType) else v.s for v in values]
    return [v.col for v in values]
