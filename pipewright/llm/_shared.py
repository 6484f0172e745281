"""Folders, size-checked broadcasts and Arrow helpers that the operators share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright import ship

#: Largest table, in bytes, that an operator ships to every executor; beyond it a shuffle join is used.
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``.  Only where it is unset (local tests) a
    temporary folder is made and set as the session's checkpoint directory."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pipewright-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def small_or_plain(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit ``limit`` bytes, else as it is (shuffle join).

    ``df`` should be a written table, so that counting it is cheap.
    """
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with a per-batch function."""

    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from function(batch)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with about ``most`` bytes of ``column`` each; a longer value stands alone."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def grouped_arrow(batches: Iterator[pa.RecordBatch], key: str, most_rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a stream sorted by ``key``: a group is never split between two tables.  Every
    row is copied once, however many batches a group runs through."""
    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy()
        if rows >= most_rows:
            cut = int(np.searchsorted(keys, last, side="right")) if keys[0] == last else 0
            if cut < len(keys):
                yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
                batch, held, rows = batch.slice(cut), [], 0
        held.append(batch)
        rows += batch.num_rows
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
