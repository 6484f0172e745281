"""Contiguous, byte-balanced shards from global prefix sums of byte sizes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright import ship
from pipewright.llm._shared import written


def _offsets(slim: DataFrame, parts: int) -> DataFrame:
    """(key, n_bytes, part, within) of every row, range-partitioned by key and written.

    ``within`` is the number of bytes of rows with a smaller key in the same part.  Range partitions keep equal
    keys together, so that rows with equal keys get equal offsets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, last_start = 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("key")
            null = np.asarray(column.is_null())
            key = np.asarray(pc.fill_null(column, 0), dtype=np.int64)
            size = np.asarray(batch.column("n_bytes"), dtype=np.int64)
            before = total + np.cumsum(size) - size
            new = np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])]
            if last is not None and last == (bool(null[0]), int(key[0])):
                new[0] = False
            starts = np.where(new, before, -1)
            if not new[0]:
                starts[0] = last_start
            within = np.maximum.accumulate(starts)
            total += int(size.sum())
            last, last_start = (bool(null[-1]), int(key[-1])), int(within[-1])
            yield pa.RecordBatch.from_arrays([column, batch.column("n_bytes"), batch.column("part"), pa.array(within)], names=["key", "n_bytes", "part", "within"])

    ranged = slim.repartitionByRange(parts, F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first()).withColumn("part", F.spark_partition_id())
    return written(ranged.mapInArrow(run, "key long, n_bytes long, part int, within long"), "shard-offsets")


def assign(docs: DataFrame, n_shards: int = 64, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(key, n_bytes, byte_start, shard) of every row of ``docs``.

    Rows are taken in the order of ``key``; ``byte_start`` counts the UTF-8 bytes of all rows with a smaller key,
    and a row's shard is ``floor(byte_start * n_shards / total)``: shards are contiguous in key order, and each is
    within one key's bytes of an equal share.  Only keys and sizes are shuffled.

    Null texts count 0 bytes; rows with a null key come first; rows with equal keys (ties, repeated rows) have one
    offset and so one shard; when no row has any byte, every row is in shard 0.  ``key`` must be an integer.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long").alias("n_bytes"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = _offsets(slim, parts)
    # One row per range partition: their running totals are the offsets of the partitions.
    totals = sorted((r["part"], r["b"]) for r in table.groupBy("part").agg(F.sum("n_bytes").alias("b")).collect())
    grand = sum(b for _, b in totals)
    running, starts = 0, []
    for p, b in totals:
        starts.append((p, running))
        running += b
    # As many rows as there are partitions: always small enough to broadcast.
    table = table.join(F.broadcast(docs.sparkSession.createDataFrame(starts, "part int, offset long")), "part")
    offset = F.col("offset")
    start = (F.col("within") + offset).cast("long")
    # Exact integer arithmetic: byte_start * n_shards stays below 2**63 up to 10**14 bytes and 90,000 shards.
    shard = F.least(F.expr(f"(byte_start * {n_shards}L) div {max(grand, 1)}L"), F.lit(n_shards - 1)).cast("int")
    return table.select("key", "n_bytes", start.alias("byte_start")).select(F.col("key").alias(key), "n_bytes", "byte_start", shard.alias("shard"))


def shard_rows(docs: DataFrame, n_shards: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus ``shard``, as :func:`assign` defines it (a column of that name is replaced).

    Each shard's first key is found from the slim table; the rows themselves are labelled in place by binary
    search among at most ``n_shards`` cut points, so no text is shuffled.
    """
    ship(docs.sparkSession)
    table = assign(docs, n_shards, key, text)
    cuts = table.where(F.col(f"`{key}`").isNotNull()).groupBy("shard").agg(F.min(f"`{key}`").alias("first")).orderBy("shard").collect()
    first = np.array([r["first"] for r in cuts], dtype=np.int64)
    shard = np.array([r["shard"] for r in cuts], dtype=np.int32)

    @F.arrow_udf("int")
    def label(keys: pa.Array) -> pa.Array:
        if not len(first):
            return pa.array(np.zeros(len(keys), dtype=np.int32))
        # Nulls never become floats: large keys keep all their digits.
        at = np.searchsorted(first, np.asarray(pc.fill_null(keys, 0), dtype=np.int64), side="right") - 1
        return pa.array(np.where(np.asarray(keys.is_null()), 0, shard[np.maximum(at, 0)]).astype(np.int32))

    return docs.withColumn("shard", label(F.col(f"`{key}`").cast("long")))


def file_order(docs: DataFrame) -> Column:
    """A column that numbers the rows of a table of files, read as it is, in the order of the files' names and of the
    rows in each: the order in which a range-sorted table was written."""
    names = docs.select(F.col("_metadata.file_name").alias("name")).groupBy("name").agg(F.lit(0)).select("name").orderBy("name").collect()
    ordinal = {r["name"]: k for k, r in enumerate(names)}

    @F.arrow_udf("long")
    def number(files: pa.Array, rows: pa.Array) -> pa.Array:
        coded = files.dictionary_encode()
        of = np.array([ordinal[x] for x in coded.dictionary.to_pylist()], dtype=np.int64)
        at = np.asarray(coded.indices, dtype=np.int64)
        return pa.array((of[at] << 40) + np.asarray(rows, dtype=np.int64))

    return number(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
