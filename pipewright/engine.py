"""The engine: query text, management commands and a fluent interface over one Spark session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from pipewright.lang import parse_script
from pipewright.lang.tree import Function, Let
from pipewright.operators.sources import RenderInfo
from pipewright.plans.frame import Frame
from pipewright.plans.lower import Lowering

#: What the lowering assumes of the session while it builds a plan.
_SETTINGS = {"spark.sql.ansi.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.caseSensitive": "true", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}


@contextmanager
def language_settings(spark: SparkSession) -> Iterator[None]:
    """The session's settings as the language needs them (no errors on overflow and bad casts, UTC, case-sensitive
    names), restored afterwards.  Expressions keep what held when they were analysed."""
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Engine:
    """``tables`` are looked up first: a mapping of names to DataFrames, or a folder of ``NAME.parquet``; then the
    session's catalog."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | str | None = None):
        self.spark = spark
        self._folder = tables if isinstance(tables, str) else None
        self._tables: dict[str, DataFrame] = dict(tables) if isinstance(tables, dict) else {}
        self._case = spark.conf.get("spark.sql.caseSensitive", "false")
        self.functions: dict[str, Function] = {}
        self.render: RenderInfo | None = None

    def register(self, name: str, df: DataFrame) -> None:
        self._tables[name] = df

    def load(self, name: str, *paths: str, **options: Any) -> DataFrame:
        """Registers files (Parquet, JSON lines, CSV, text, ORC; gzipped or not) as a table."""
        from pipewright.sources import readers

        df = readers.read(self.spark, list(paths), options.pop("format", None), None, options)
        self.register(name, df)
        return df

    def frames(self, text: str, version: int = 2, progressive: bool = False) -> Any:
        """A query's result as JSON-ready frames: a table object (1) or an iterator of frames (2)."""
        from pipewright.sources import frames

        df = self.query(text)
        return frames.version_1(df) if version == 1 else frames.version_2(df, self.render, progressive)

    def table(self, name: str) -> DataFrame | None:
        if name in self._tables:
            return self._tables[name]
        if self._folder is not None:
            try:
                df = self.spark.read.parquet(f"{self._folder}/{name}.parquet")
            except AnalysisException:
                df = None
            if df is not None:
                self._tables[name] = df
                return df
        # The catalog stores names as the session's own setting has them.
        now = self.spark.conf.get("spark.sql.caseSensitive")
        self.spark.conf.set("spark.sql.caseSensitive", self._case)
        try:
            return self.spark.table(f"`{name}`") if self.spark.catalog.tableExists(name) else None
        finally:
            self.spark.conf.set("spark.sql.caseSensitive", now)

    def names(self) -> list[str]:
        return sorted({*self._tables, *self._files(), *(t.name for t in self.spark.catalog.listTables())})

    def _files(self) -> list[str]:
        """The tables in the folder."""
        if self._folder is None:
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        listed = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return [n.removesuffix(".parquet") for n in (s.getPath().getName() for s in listed) if n.endswith(".parquet")]

    def _lowering(self) -> Lowering:
        return Lowering(self.spark, self.table, self.names, self.functions)

    def frame(self, text: str) -> Frame:
        script = parse_script(text)
        with language_settings(self.spark):
            lowering = self._lowering()
            out = lowering.script(script.lets, script.query)
            self.render = lowering.render
            return out

    def query(self, text: str) -> DataFrame:
        """The query's rows, lazily.  ``render`` details of the last query are in :attr:`render`."""
        frame = self.frame(text)
        with language_settings(self.spark):
            return frame.result()

    def explain(self, text: str, mode: str = "formatted") -> str:
        """Spark's plan of a query."""
        df = self.query(text)
        return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def execute(self, text: str) -> DataFrame:
        """A query, or a management command (it starts with a dot)."""
        from pipewright.sources.commands import run_command

        stripped = text.strip()
        return run_command(self, stripped) if stripped.startswith(".") else self.query(stripped)

    def define(self, text: str) -> None:
        """Stores the functions of ``let`` statements for later queries."""
        for let in parse_script(text).lets:
            if not isinstance(let.value, Function):
                let = Let(let.name, Function([], let.value))
            self.functions[let.name] = let.value

    def pipe(self, source: str) -> Pipe:
        """A fluent pipeline that starts with a table or any tabular expression."""
        return Pipe(self, source)


class Pipe:
    """A pipeline under construction: ``engine.pipe("T").where("a > 1").summarize("n=count()", by="k").df()``.

    Every operator of the language is a method: its name with underscores for dashes.  Arguments are pieces of the
    language; several are joined by commas; ``by`` and ``on`` follow the operator's other arguments.
    """

    def __init__(self, engine: Engine, text: str):
        self.engine, self.text = engine, text

    def __getattr__(self, name: str) -> Callable[..., Pipe]:
        from pipewright.operators import OPERATORS

        kind = name.rstrip("_").replace("_", "-")
        if kind not in OPERATORS:
            raise AttributeError(name)

        def add(*args: str, by: str | None = None, on: str | None = None, **options: Any) -> Pipe:
            words = [kind, *[f"{k}={v}" for k, v in options.items()]]
            if args:
                words.append(", ".join(f"({a.text})" if isinstance(a, Pipe) else str(a) for a in args))
            if on:
                words.append(f"on {on}")
            if by:
                words.append(f"by {by}")
            return Pipe(self.engine, f"{self.text}\n| {' '.join(words)}")

        return add

    def df(self) -> DataFrame:
        return self.engine.query(self.text)

    def __str__(self) -> str:
        return self.text
