"""Readers and writers of inline rows and files."""

from __future__ import annotations

import csv
import datetime as dt
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.functions import QueryError
from pipewright.lang.tree import DataTable, Lit, Un

_EXTENSIONS = {".parquet": "parquet", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".orc": "orc", ".txt": "text", ".log": "text"}


def schema_of(columns: list[tuple[str, str]]) -> T.StructType:
    for n, kind in columns:
        if kind not in K.SPARK:
            raise QueryError(f"no type {kind!r} (column {n!r})")
    return T.StructType([T.StructField(n, K.SPARK[kind], True, K.DYNAMIC if kind == "dynamic" else {}) for n, kind in columns])


def python_value(value: Any, kind: str, literal_kind: str = "") -> Any:
    """A constant as the Python value of a column of the type ``kind``; null where it cannot be one."""
    if value is None:
        return "" if kind == "string" else None
    try:
        if kind in ("bool", "boolean"):
            return value if isinstance(value, bool) else {"true": True, "1": True, "false": False, "0": False}.get(str(value).lower())
        if kind in ("int", "long"):
            return int(float(value)) if isinstance(value, str) and not value.lstrip("+-").isdigit() else int(value)
        if kind in ("real", "double"):
            return float(value)
        if kind == "decimal":
            import decimal

            return decimal.Decimal(str(value))
        if kind in ("datetime", "date"):
            return value if isinstance(value, dt.datetime) else K.parse_datetime(str(value))
        if kind in ("timespan", "time"):
            from pipewright.lang.parser import span_micros

            us = value if isinstance(value, int) and literal_kind == "timespan" else span_micros(str(value))
            return None if us is None else dt.timedelta(microseconds=us)
        if kind == "dynamic":
            # A string stands for itself, as it does where navigation yields one.
            return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False)
        if kind == "guid":
            return str(value).lower()
    except (ValueError, ArithmeticError):
        return None
    return ("True" if value else "False") if isinstance(value, bool) else str(value)


def inline(lowering: Any, e: DataTable, env: dict) -> DataFrame:
    """``datatable``: its cells are constants, so the rows are made on the driver."""
    schema = schema_of(e.columns)
    n = len(e.columns)
    if not n or len(e.values) % n:
        raise QueryError("datatable: the number of values is no multiple of the number of columns")
    cells = []
    for k, v in enumerate(e.values):
        kind = e.columns[k % n][1]
        if isinstance(v, Lit):
            cells.append(python_value(v.value, kind, v.type))
        elif isinstance(v, Un) and isinstance(v.x, Lit):
            cells.append(python_value(-v.x.value if v.op == "-" else v.x.value, kind, v.x.type))
        else:
            from pipewright.plans.expressions import Scope
            from pipewright.plans.frame import Frame

            cells.append(python_value(Scope(lowering, Frame(lowering.spark.range(1)), env).constant(v), kind))
    rows = [tuple(cells[k : k + n]) for k in range(0, len(cells), n)]
    return with_order(lowering.spark.createDataFrame(rows, schema), schema)


def with_order(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Puts the metadata of JSON text back on, which rows made in Python do not carry."""
    return df.select(*[F.col("`" + f.name + "`").alias(f.name, metadata=f.metadata) if f.metadata else F.col("`" + f.name + "`") for f in schema.fields])


def format_of(uri: str) -> str:
    path = uri.split("?", 1)[0].lower()
    for suffix in (".gz", ".bz2", ".zst"):
        path = path.removesuffix(suffix)
    return next((f for ext, f in _EXTENSIONS.items() if path.endswith(ext)), "csv")


def read(spark: SparkSession, uris: list[str], fmt: str | None = None, schema: T.StructType | None = None, options: dict[str, Any] | None = None) -> DataFrame:
    """Files of one format, by extension if none is given; a schema is applied where the format takes one."""
    options = {k.lower(): v for k, v in (options or {}).items()}
    fmt = fmt or str(options.get("format") or format_of(uris[0])).lower()
    fmt = {"jsonl": "json", "multijson": "json", "txt": "text", "tsv": "csv", "psv": "csv"}.get(fmt, fmt)
    reader = spark.read
    if fmt == "csv":
        header = not (str(options.get("ignorefirstrecord", "true")).lower() == "false" or options.get("header") is False)
        reader = reader.option("header", header).option("enforceSchema", True)
        if str(options.get("format", "")).lower() == "tsv":
            reader = reader.option("sep", "\t")
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None and fmt != "text":
        return reader.schema(T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])).format(fmt).load(uris)
    if fmt == "json" and options.get("multiline"):
        reader = reader.option("multiLine", True)
    return reader.format(fmt).load(uris)


def external(spark: SparkSession, columns: list[tuple[str, str]], uris: list[str], options: dict[str, Any]) -> DataFrame:
    """``externaldata``: all files, with the declared columns."""
    if not uris:
        raise QueryError("externaldata: no address")
    schema = schema_of(columns)
    df = read(spark, uris, None, schema, options)
    return with_order(df, schema)


def parse_rows(text: str, columns: list[tuple[str, str]]) -> list[tuple]:
    """Rows of inline comma-separated text."""
    return [tuple(python_value(v if v != "" or kind == "string" else None, kind) for v, (_, kind) in zip(r, columns, strict=True)) for r in csv.reader(text.strip().splitlines(), skipinitialspace=True) if r]


def write(df: DataFrame, fmt: str, path: str, mode: str = "error") -> None:
    fmt = {"jsonl": "json"}.get(fmt.lower(), fmt.lower())
    writer = df.write.mode(mode)
    if fmt == "csv":
        flat = df.select(*[K.text(F.col("`" + f.name + "`"), f.dataType).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.DayTimeIntervalType)) else F.col("`" + f.name + "`") for f in df.schema.fields])
        flat.write.mode(mode).option("header", True).csv(path)
        return
    writer.format(fmt).save(path)
