import datetime as dt

from pyspark.sql import functions as F

from pipewright import streaming

ROWS = [(dt.datetime(2024, 1, 1, 0, m), k, v) for m, k, v in ((0, "a", 1), (1, "a", 2), (7, "b", 3), (8, "a", 4), (40, "b", 5), (41, "b", 5))]


def stream(spark, tmp_path):
    spark.createDataFrame(ROWS, "ts timestamp_ntz, k string, v long").coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema("ts timestamp_ntz, k string, v long").parquet(str(tmp_path / "in"))


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return sorted(tuple(r) for r in df.sparkSession.table(name).collect())


def test_windows(spark, tmp_path):
    out = streaming.windowed_summarize(stream(spark, tmp_path), "ts", 5 * 60_000_000, [F.sum("v").alias("s")], ["k"])
    got = run(out, tmp_path, "w", "complete")
    assert (dt.datetime(2024, 1, 1, 0, 0), "a", 3) in got and (dt.datetime(2024, 1, 1, 0, 5), "a", 4) in got


def test_sessions_and_distinct(spark, tmp_path):
    df = stream(spark, tmp_path)
    got = run(streaming.sessions(df, "ts", "10 minutes", [F.count(F.lit(1)).alias("n")], ["k"]), tmp_path, "s")
    assert ("a", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 18), 3) in got
    assert len(run(streaming.distinct(df, ["k", "v"], "ts"), tmp_path, "d")) == 5


def test_materialize(spark, tmp_path):
    q = streaming.materialize_into(stream(spark, tmp_path), lambda b: b.groupBy("k").agg(F.sum("v").alias("s")), str(tmp_path / "view"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["k"], r["s"]) for r in spark.read.parquet(str(tmp_path / "view")).collect()) == [("a", 7), ("b", 13)]
