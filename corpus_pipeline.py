"""The corpus pipeline: five stages from raw documents to training shards.

Each stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright.llm import decontaminate, jaccard, lang_id, mixing, sharding
from pipewright.llm._shared import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have an identified language; the model is fitted on a bounded sample of them.

    Null, empty and letterless texts go, of any length; rows without ``lang`` are scored but not fitted on.  Repeated
    rows get one decision, ties go to the language first in the alphabet, further columns stay as they are whatever
    their names, and an empty table stays empty.
    """
    return lang_id.filter_languages(docs, lang_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones, that with the smallest ``doc_id``.

    Rows with a null ``doc_id`` or a null or wordless text are in no class and stay; of repeated rows one stays; of a
    ``doc_id`` with several texts all rows go if one must.  Further columns stay as they are, an empty table empty.
    """
    return jaccard.deduplicate(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Null and empty texts and rows with a null ``doc_id`` stay; all rows of a contaminated ``doc_id`` go, repeated ones
    among them.  Further columns stay as they are, an empty table (or benchmark) changes nothing.
    """
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents of the sources with any weight, in training order: the rows are range-sorted, and so are the files
    that they are written to, by which the next stage takes them.

    A null source is a source like any other; null and empty texts take the position of their turn; repeated rows
    follow one another; ties are in the order of a hash and of ``doc_id``.  A source without a single token goes.
    Columns named ``n_tokens`` or ``position`` stay as they are, as do all others; an empty table stays empty.
    """
    names = {c: f"__{k}" for k, c in enumerate(docs.columns)}
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    mixed = mixing.mix(inner, source=names["source"], key=names["doc_id"], text=names["text"], carry=list(names.values()))
    return mixed.select(*[F.col(n).alias(c) for c, n in names.items()])


def byte_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard: consecutive stretches of the training order, of equal size in bytes.

    ``docs`` must be a table of files, as the stage before leaves it: the order is that of its files and of the rows in
    them.  Null texts count 0 bytes; every row, repeated or with nulls, has its own place in the order.  A column named
    ``shard`` is replaced, all others stay; an empty table stays empty.
    """
    order = "__order"
    while order in docs.columns:
        order += "_"
    return sharding.shard_rows(docs.withColumn(order, sharding.file_order(docs)), key=order).drop(order)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("byte_shards", byte_shards),
]

#: Naive Bayes scores and sampled paths are not SQL's: tests/llm compares the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
