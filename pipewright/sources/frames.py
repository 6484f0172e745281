"""Results as the JSON frames that dashboards of the language read: version 1 tables and version 2 frame lists.

Rows are fetched partition by partition, so the driver holds one fragment at a time.
"""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pipewright import types as K
from pipewright.operators.sources import RenderInfo


def columns(df: DataFrame) -> list[dict[str, str]]:
    """Name and type of each column."""
    out = []
    for f in df.schema.fields:
        kind = K.name_of(f.dataType, isinstance(f.dataType, T.StringType) and f.metadata == K.DYNAMIC)
        out.append({"ColumnName": f.name, "ColumnType": kind})
    return out


def cell(v: Any) -> Any:
    """A value as JSON has it: times as text, infinities and NaN as their names."""
    if isinstance(v, float):
        return v if math.isfinite(v) else "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"
    if isinstance(v, dt.datetime):
        return v.isoformat(timespec="microseconds") + "0Z"
    if isinstance(v, dt.timedelta):
        us = v // dt.timedelta(microseconds=1)
        sign, us = ("-", -us) if us < 0 else ("", us)
        days, rest = divmod(us, 86_400_000_000)
        clock = f"{rest // 3_600_000_000:02d}:{rest // 60_000_000 % 60:02d}:{rest // 1_000_000 % 60:02d}"
        return f"{sign}{f'{days}.' if days else ''}{clock}{f'.{rest % 1_000_000:06d}0' if rest % 1_000_000 else ''}"
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    if isinstance(v, (list, tuple)):
        return [cell(x) for x in v]
    return v


def fragments(df: DataFrame, rows: int = 5000) -> Iterator[list[list[Any]]]:
    """Lists of at most ``rows`` rows, in order."""
    held: list[list[Any]] = []
    for r in df.toLocalIterator(prefetchPartitions=True):
        held.append([cell(v) for v in r])
        if len(held) >= rows:
            yield held
            held = []
    if held:
        yield held


def version_1(df: DataFrame) -> dict[str, Any]:
    """One table object."""
    names = [{**c, "DataType": K.clr_name(c["ColumnType"])} for c in columns(df)]
    return {"Tables": [{"TableName": "Table_0", "Columns": names, "Rows": [r for f in fragments(df) for r in f]}]}


def visualization(info: RenderInfo | None) -> str:
    """The chart's description as JSON text; without one every entry is empty."""
    i = info or RenderInfo("")
    entries = {
        "Visualization": i.kind or None, "Title": i.title, "XColumn": i.x_column, "Series": list(i.series) or None, "YColumns": list(i.y_columns) or None, "AnomalyColumns": list(i.anomaly_columns) or None, "XTitle": i.x_title, "YTitle": i.y_title,
        "XAxis": i.x_axis, "YAxis": i.y_axis, "Legend": i.legend, "YSplit": i.y_split, "Accumulate": i.accumulate, "IsQuerySorted": i.sorted, "Kind": i.variant, "Ymin": "NaN" if i.y_min is None else i.y_min, "Ymax": "NaN" if i.y_max is None else i.y_max, "Xmin": i.x_min, "Xmax": i.x_max,
    }
    return json.dumps(entries)


def version_2(df: DataFrame, info: RenderInfo | None = None, progressive: bool = False) -> Iterator[dict[str, Any]]:
    """The frames of a result, one after the other; progressive ones carry the rows in fragments."""
    yield {"FrameType": "DataSetHeader", "IsProgressive": progressive, "Version": "v2.0", "IsFragmented": False, "ErrorReportingPlacement": "InData"}
    table = {"TableId": 1, "TableKind": "PrimaryResult", "TableName": "PrimaryResult"}
    if progressive:
        yield {"FrameType": "TableHeader", **table, "Columns": columns(df)}
        count = 0
        for part in fragments(df):
            count += len(part)
            yield {"FrameType": "TableFragment", "TableId": 1, "FieldCount": len(df.columns), "TableFragmentType": "DataAppend", "Rows": part}
        yield {"FrameType": "TableCompletion", "TableId": 1, "RowCount": count}
    else:
        about = [{"ColumnName": n, "ColumnType": t} for n, t in (("TableId", "int"), ("Key", "string"), ("Value", "dynamic"))]
        yield {"FrameType": "DataTable", "TableId": 0, "TableKind": "QueryProperties", "TableName": "@ExtendedProperties", "Columns": about, "Rows": [[1, "Visualization", visualization(info)]]}
        yield {"FrameType": "DataTable", **table, "Columns": columns(df), "Rows": [r for f in fragments(df) for r in f]}
        done = [{"ColumnName": n, "ColumnType": t} for n, t in (("Timestamp", "datetime"), ("Level", "int"), ("StatusCode", "int"), ("StatusCodeName", "string"), ("Payload", "string"))]
        yield {"FrameType": "DataTable", "TableId": 2, "TableKind": "QueryCompletionInformation", "TableName": "QueryCompletionInformation", "Columns": done, "Rows": [[cell(dt.datetime.now(dt.UTC).replace(tzinfo=None)), 4, 0, "S_OK (0)", "{}"]]}
    yield {"FrameType": "DataSetCompletion", "HasErrors": False, "Cancelled": False}
