"""A DataFrame with what the language knows besides: row order, partition key, name."""

from __future__ import annotations

import itertools
import warnings
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K

_counter = itertools.count()
#: Columns that carry order keys and the like beside the visible ones.
HIDDEN = "__pw"
#: In a timespan's metadata: the hidden column of its microseconds, which may not fit the timespan.
MICROS = "pipewright_micros"


def fresh(what: str = "x") -> str:
    return f"{HIDDEN}_{what}{next(_counter)}"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's output."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


@dataclass(frozen=True)
class Frame:
    """``order``: (column name, ascending, nulls first) of the serialized order.  ``keys``: names of the columns that
    partition it (inside ``partition`` and ``mv-apply``).  ``parts``: how many parts of the order there are, where window
    functions have dealt the rows into them."""

    df: DataFrame
    order: tuple[tuple[str, bool, bool], ...] = ()
    keys: tuple[str, ...] = ()
    name: str = ""
    parts: int = 0
    _cache: dict[str, Any] = field(default_factory=dict, compare=False, repr=False)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def with_df(self, df: DataFrame, **changes: Any) -> Frame:
        return replace(self, df=df, _cache={}, **changes)

    def plain(self, df: DataFrame) -> Frame:
        """A new row set without order; the partition keys stay."""
        return Frame(df, (), self.keys)

    @property
    def fields(self) -> dict[str, T.StructField]:
        if "fields" not in self._cache:
            self._cache["fields"] = {f.name: f for f in self.df.schema.fields}
        return self._cache["fields"]

    def type_of(self, c: Column) -> T.DataType:
        """The type Spark's analyzer gives an expression over this frame."""
        return self.df.select(c.alias("x")).schema[0].dataType

    def is_json(self, name: str) -> bool:
        f = self.fields.get(name)
        return bool(f and isinstance(f.dataType, T.StringType) and f.metadata.get("pipewright") == "dynamic")

    def ordering(self) -> list[Column]:
        out = []
        for name, ascending, first in self.order:
            c = quoted(name)
            out.append((c.asc_nulls_first() if first else c.asc_nulls_last()) if ascending else (c.desc_nulls_first() if first else c.desc_nulls_last()))
        return out

    def window(self, *extra_keys: Column) -> WindowSpec:
        """A window over the serialized order.  Without one, rows are taken as they are read."""
        order = self.ordering()
        if not order:
            warnings.warn("a window function over rows without an order: sort them first", stacklevel=3)
            order = [F.monotonically_increasing_id()]
        return Window.partitionBy(*[quoted(k) for k in self.keys], *extra_keys).orderBy(*order)

    def select_visible(self, exprs: list[Column], kept: set[str] | None = None) -> Frame:
        """``select`` that carries hidden columns and those that the order or the keys need along as hidden ones.
        ``kept``: names whose values go on unchanged."""
        kept = kept or set()
        renamed: dict[str, str] = {}
        carried = [quoted(c) for c in self.hidden]
        for n in [*(o[0] for o in self.order), *self.keys]:
            if not n.startswith(HIDDEN) and n not in kept and n not in renamed:
                renamed[n] = fresh("o")
                carried.append(quoted(n).alias(renamed[n]))
        df = self.df.select(*exprs, *carried)
        order = tuple((renamed.get(n, n), a, f) for n, a, f in self.order)
        return self.with_df(df, order=order, keys=tuple(renamed.get(k, k) for k in self.keys))

    def result(self) -> DataFrame:
        """The visible columns."""
        return self.df.select(*[quoted(c) for c in self.columns]) if self.hidden else self.df


def json_alias(c: Column, name: str) -> Column:
    """Names a column and marks it as JSON text."""
    return c.alias(name, metadata=K.DYNAMIC)
