from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pipewright.llm import lang_id
from tests.llm.helpers import DATA, SCHEMA, odd
from tests.llm.test_decontaminate import contaminated
from tests.llm.test_jaccard import brute, links
from tests.llm.test_mixing import brute as positions


def stages(spark, docs, folder, sf_dir=DATA):
    """Each stage's rows, written and read again as the pipeline does."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    one, two, three, four, five = stages(spark, docs, tmp_path)
    kept = [{r["doc_id"] for r in t.select("doc_id").collect()} for t in (one, two, three, four, five)]
    # Languages: the same decisions text by text.
    model = lang_id.fit(docs)
    want = set()
    for k, t in texts.items():
        total, n = lang_id.score_texts(model, [t])
        row = lang_id.decide(model, total, n).iloc[0]
        if row["language"] != "und" and row["language_score"] >= 0.5 and row["language_fit"] >= -25.0 * (1 + 300 / n[0]) ** 0.5:
            want.add(k)
    assert kept[0] == want
    # Near duplicates: of all classes that comparing all pairs gives, the smallest stays (the recall allows for a few more).
    rows = [(k, texts[k]) for k in sorted(kept[0])]
    gone = {k for k, c, _, _ in links(brute(rows), rows) if k != c}
    assert kept[0] - kept[1] <= gone and len(kept[0] - kept[1]) >= 0.97 * len(gone)
    # Decontamination.
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert kept[1] - kept[2] == {k for k in kept[1] if contaminated(texts[k], items)}
    # Mixing: everything, in the order of the positions.
    assert kept[3] == kept[2] == kept[4]
    want = positions([(r["doc_id"], r["source"], len(r["text"].split())) for r in three.collect()], whole=True)
    order = [r["doc_id"] for r in four.select("doc_id", corpus_pipeline.sharding.file_order(four).alias("n")).orderBy("n").collect()]
    assert all(want[a] <= want[b] + 1e-6 for a, b in zip(order, order[1:]))
    # Shards: equal cuts through that order.
    size = {r["doc_id"]: len(r["text"].encode()) for r in four.collect()}
    total, at, shard = sum(size.values()), 0, {}
    for k in order:
        shard[k] = min(at * 64 // total, 63)
        at += size[k]
    assert {r["doc_id"]: r["shard"] for r in five.collect()} == shard
    assert four.columns == docs.columns and five.columns == [*docs.columns, "shard"]


def test_run_is_the_stages_in_turn(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = Counter((r["doc_id"], r["shard"]) for r in stages(spark, docs, tmp_path)[-1].collect())
    assert Counter((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, DATA).collect()) == want and len(want) > 50


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_with_clashing_columns(spark, tmp_path, empty):
    docs = odd(spark).withColumn("n_tokens", F.lit("mine")).withColumn("position", F.lit("own")).withColumn("a b", F.lit(1)).drop("a.b")
    out = stages(spark, docs.limit(0) if empty else docs, tmp_path)
    for k, t in enumerate(out):
        assert t.columns == docs.columns + ["shard"] * (k == 4)
    rows = out[-1].collect()
    assert (not rows) == empty and all((r["n_tokens"], r["position"]) == ("mine", "own") for r in rows)
    assert SCHEMA.startswith("doc_id")
