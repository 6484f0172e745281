import duckdb
import pytest
from pyspark.sql import functions as F

from pipewright.llm import queries, sharding
from tests.llm.helpers import DATA, SCHEMA, documents, odd


def test_against_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op10_sharding"]).fetchall())
    out = sharding.assign(docs)
    assert sorted((r["doc_id"], r["n_bytes"], r["byte_start"], r["shard"]) for r in out.collect()) == want


def test_shards_are_contiguous_and_balanced(spark):
    docs = documents(spark, ["x" * (k % 97) for k in range(1000)])
    rows = sorted((r["doc_id"], r["shard"], r["n_bytes"]) for r in sharding.assign(docs, 10, parts=7).collect())
    shards = [s for _, s, _ in rows]
    assert shards == sorted(shards) and set(shards) == set(range(10))
    sizes = [sum(n for _, s, n in rows if s == k) for k in range(10)]
    assert max(sizes) - min(sizes) <= 2 * 96
    labelled = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(docs, 10).collect()}
    assert labelled == {k: s for k, s, _ in rows}


def test_nulls_among_large_keys(spark):
    keys = [None, None, *(2**53 + k for k in range(-20, 20)), 2**62, -(2**62)]
    docs = documents(spark, [(k, "x" * 7) for k in keys])
    want = {(r["doc_id"], r["shard"]) for r in sharding.assign(docs, 16).collect()}
    assert {(r["doc_id"], r["shard"]) for r in sharding.shard_rows(docs.coalesce(1), 16).collect()} == want


def test_order_of_files(spark, tmp_path):
    spark.range(500).withColumn("v", F.rand(3)).orderBy("v").write.option("maxRecordsPerFile", 30).parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    rows = table.select("v", sharding.file_order(table).alias("n")).collect()
    assert len({r["n"] for r in rows}) == 500
    values = [r["v"] for r in sorted(rows, key=lambda r: r["n"])]
    assert values == sorted(values)


def test_odd_rows(spark):
    table = odd(spark).withColumnRenamed("component", "shard")
    out = sharding.assign(table, 4).collect()
    assert len(out) == table.count()
    by = {}
    for r in out:
        assert by.setdefault(r["doc_id"], (r["byte_start"], r["shard"])) == (r["byte_start"], r["shard"])
    assert by[None][0] == 0
    labelled = sharding.shard_rows(table, 4)
    assert set(labelled.columns) == set(table.columns)
    assert {(r["doc_id"], r["shard"]) for r in labelled.collect()} == {(k, s) for k, (_, s) in by.items()}
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.assign(empty).count() == 0 and sharding.shard_rows(empty).count() == 0
    assert {r["shard"] for r in sharding.assign(documents(spark, ["", None, ""]), 8).collect()} == {0}
    with pytest.raises(ValueError):
        sharding.assign(empty, 0)
