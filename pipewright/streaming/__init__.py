"""Streaming forms of the operators that have one: the same logic over ``readStream`` sources, with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright import types as K

__all__ = ["distinct", "materialize_into", "sessions", "windowed_summarize"]


def _origin(micros: int) -> str:
    """How far windows of this size, counted from 0001-01-01, are shifted from those that Spark counts from 1970."""
    return f"{(-K.EPOCH) % micros} microseconds"


def windowed_summarize(df: DataFrame, time: str, span_micros: int, aggregates: list[Column], by: list[str] | None = None, late: str = "10 minutes", slide_micros: int | None = None) -> DataFrame:
    """``summarize … by bin(time, span)`` over a stream: tumbling windows (sliding ones with ``slide_micros``), aligned
    as ``bin`` aligns them.  Rows later than ``late`` behind the newest are dropped with their window's state."""
    stamp = df.withColumn("__time", F.col(f"`{time}`").cast("timestamp")).withWatermark("__time", late)
    slide = slide_micros or span_micros
    window = F.window("__time", f"{span_micros} microseconds", f"{slide} microseconds", _origin(slide))
    out = stamp.groupBy(window.alias("__window"), *[F.col(f"`{k}`") for k in by or []]).agg(*aggregates)
    return out.select(F.col("__window.start").cast("timestamp_ntz").alias(time), *[c for c in out.columns if c != "__window"])


def sessions(df: DataFrame, time: str, gap: str, aggregates: list[Column], by: list[str], late: str = "10 minutes") -> DataFrame:
    """``row_window_session`` over a stream: one row for each session of a key, closed once the watermark passed it."""
    stamp = df.withColumn("__time", F.col(f"`{time}`").cast("timestamp")).withWatermark("__time", late)
    out = stamp.groupBy(F.session_window("__time", gap).alias("__session"), *[F.col(f"`{k}`") for k in by]).agg(*aggregates)
    bounds = [F.col("__session.start").cast("timestamp_ntz").alias("session_start"), F.col("__session.end").cast("timestamp_ntz").alias("session_end")]
    return out.select(*[F.col(f"`{k}`") for k in by], *bounds, *[c for c in out.columns if c not in (*by, "__session")])


def distinct(df: DataFrame, columns: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """``distinct`` over a stream: the first row of each combination, remembered for ``late``."""
    stamp = df.withColumn("__time", F.col(f"`{time}`").cast("timestamp")).withWatermark("__time", late)
    return stamp.dropDuplicatesWithinWatermark(columns).drop("__time")


def materialize_into(df: DataFrame, query: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A materialized view: each micro-batch goes through ``query`` and is appended to ``path``, under the batch's
    number, so that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        query(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
