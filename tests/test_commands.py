import pytest

from pipewright.engine import Engine
from pipewright.functions import QueryError


@pytest.fixture
def engine(spark):
    spark.sql("DROP DATABASE IF EXISTS cmd CASCADE")
    spark.sql("CREATE DATABASE cmd")
    spark.catalog.setCurrentDatabase("cmd")
    yield Engine(spark)
    spark.catalog.setCurrentDatabase("default")
    spark.sql("DROP DATABASE IF EXISTS cmd CASCADE")


def values(engine, text):
    return sorted(tuple(r) for r in engine.execute(text).collect())


def test_tables(engine):
    engine.execute(".create table T (a:long, b:string)")
    engine.execute(".ingest inline into table T <| 1,x\n2,\"y, z\"")
    assert values(engine, "T") == [(1, "x"), (2, "y, z")]
    engine.execute(".alter-merge table T (a:long, c:real)")
    assert values(engine, "T | where isnull(c) | count") == [(2,)]
    engine.execute(".rename column T.c to d")
    engine.execute(".alter column T.a type=string")
    assert engine.execute("T").dtypes == [("a", "string"), ("b", "string"), ("d", "double")]
    engine.execute(".drop column T.d")
    engine.execute(".delete table T records <| where a == '1'")
    assert values(engine, "T") == [("2", "y, z")]
    engine.execute(".create table U based-on T")
    engine.execute(".rename tables T to U, U to T")
    assert values(engine, "U | count") == [(1,)] and values(engine, "T | count") == [(0,)]
    assert [r[0].lower() for r in engine.execute(".show tables").collect()] == ["t", "u"]
    engine.execute(".clear table U data")
    assert values(engine, "U | count") == [(0,)]
    engine.execute(".drop table U")
    engine.execute(".drop table U ifexists")
    assert "a:string" in engine.execute(".show table T details").first()["Schema"]


def test_set_and_append(engine):
    engine.execute(".set S <| range x from 1 to 3 step 1")
    engine.execute(".append S <| print x=9")
    engine.execute(".set-or-append S <| print x=10")
    assert values(engine, "S") == [(1,), (2,), (3,), (9,), (10,)]
    engine.execute(".set-or-replace S <| S | where x > 5")
    assert values(engine, "S") == [(9,), (10,)]
    with pytest.raises(QueryError):
        engine.execute(".set S <| print x=1")
    engine.execute(".set stored_query_result R <| S | take 1")
    assert values(engine, "R | count") == [(1,)]
    engine.execute(".drop stored_query_result R")


def test_functions_views_and_files(engine, tmp_path):
    engine.execute(".create function twice (x:long) { x * 2 }")
    engine.execute(".create-or-alter function Some(n:long) { range x from 1 to n step 1 }")
    assert values(engine, "print twice(4)") == [(8,)]
    assert values(engine, "Some(2) | extend y=twice(x)") == [(1, 2), (2, 4)]
    engine.execute(".view V <| Some(3)")
    assert values(engine, "V | count") == [(3,)]
    engine.execute(f".export to parquet ('{tmp_path}/out') <| V")
    engine.execute(f".create external table E (x:long) kind=storage dataformat=parquet ('{tmp_path}/out')")
    assert values(engine, "E | summarize sum(x)") == [(6,)]
    (tmp_path / "in.csv").write_text("a,b\n1,x\n2,y\n")
    assert values(engine, f"externaldata(a:long, b:string)['{tmp_path}/in.csv']") == [(1, "x"), (2, "y")]
    engine.execute(".create table F (a:long, b:string)")
    engine.execute(f".ingest into table F '{tmp_path}/in.csv'")
    assert values(engine, "F | count") == [(2,)]
    engine.execute(".create materialized-view M on table F { F | summarize n=count() by b }")
    assert values(engine, "M") == [("x", 1), ("y", 1)]
    engine.execute(".execute database script <|\n.create table G (a:long)\n.ingest inline into table G <| 5")
    assert values(engine, "G") == [(5,)]
    assert engine.execute(".show functions").count() == 3
    engine.execute(".drop function twice")
    with pytest.raises(QueryError):
        engine.execute(".nonsense")
