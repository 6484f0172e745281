import numpy as np
from pyspark.sql import functions as F

from pipewright.llm import lang_id
from tests.llm.helpers import SCHEMA, documents, odd

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = lang_id.fit(docs.where("doc_id % 2 = 0"), sample_rows=100)
    held = docs.where("doc_id % 2 = 1 and length(text) >= 100")
    found = lang_id.identify(held, model, keep=("doc_id", "lang")).collect()
    assert np.mean([r["lang"] == r["language"] for r in found]) >= 0.95
    kept = lang_id.filter_languages(held, model)
    assert kept.columns == docs.columns and kept.count() >= 0.98 * held.count()


def test_scores_match_a_plain_sum():
    texts = ["the cat sat on the mat", "der hund und die katze", "le chat est sur la table"] * 4
    labels = ["en", "de", "fr"] * 4
    model = lang_id.fit_local(texts, labels)
    together, n = lang_id.score_texts(model, texts)
    for k, t in enumerate(texts):
        alone, m = lang_id.score_texts(model, [t])
        assert np.allclose(alone[0], together[k]) and m[0] == n[k]
    assert lang_id.decide(model, together, n)["language"].tolist() == labels


def test_odd_rows(spark):
    table = odd(spark)
    model = lang_id.fit(spark.read.parquet(f"{DATA}/documents.parquet"), sample_rows=60)
    out = {(r["doc_id"], r["language"]) for r in lang_id.identify(table, model).collect()}
    assert (1, "und") in out and (2, "und") in out and (3, "und") in out
    kept = lang_id.filter_languages(table, model, min_score=0.0, min_fit=-1e9)
    assert kept.columns == table.columns and kept.count() == 7
    assert lang_id.filter_languages(spark.createDataFrame([], SCHEMA), model).count() == 0
    nothing = lang_id.fit(spark.createDataFrame([], SCHEMA))
    assert nothing.languages == () and lang_id.identify(documents(spark, ["abc"]), nothing).first()["language"] == "und"


def test_repeated_rows_and_clashing_names(spark):
    """A label of equal rows is in the model, however many there are; kept names give way to results."""
    docs = documents(spark, ["same words again"] * 6000, lang="xx").union(documents(spark, [f"other text number {k}" for k in range(50)], lang="yy"))
    for text in ("same words again", "quite another one", "third text"):
        own = docs.withColumn("text", F.when(F.col("lang") == "xx", F.lit(text)).otherwise(F.col("text")))
        assert lang_id.fit(own, sample_rows=100).languages == ("xx", "yy")
    model = lang_id.fit(docs, sample_rows=100)
    out = lang_id.identify(docs.withColumn("language", F.lit("mine")), model, keep=("doc_id", "language"))
    assert out.columns == ["doc_id", "language", "language_score", "language_fit", "n_grams"]
    assert {r["language"] for r in out.collect()} == {"xx", "yy"}


def test_short_gibberish_goes(spark):
    model = lang_id.fit(spark.read.parquet(f"{DATA}/documents.parquet"))
    docs = documents(spark, ["жщыюф " * 8, "天地玄黄 " * 6, "the"])
    assert {r["doc_id"] for r in lang_id.filter_languages(docs, model).collect()} <= {2}


def test_sample_bounds(spark):
    docs = documents(spark, [f"text number {k} of many" for k in range(300)])
    assert lang_id.fit(docs, sample_rows=5).languages == ("en",)
    assert lang_id.fit(docs, sample_bytes=1).languages == ("en",)
