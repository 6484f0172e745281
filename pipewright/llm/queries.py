"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pipewright.llm import decontaminate, html, jaccard, lang_id, mixing, pii, sharding, suffix, vectors, warc_zip


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redactions(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lang_id.identify(docs, lang_id.fit(docs))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(_table(spark, sf_dir, "pages"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeats(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_ngram_jaccard, op3_pii, op4_language_id, op5_decontamination, op6_html, op7_embedding_dedup, op8_warc_zip, op9_suffix_dedup, op10_sharding)}


def _mixing_sql(c: mixing.Curriculum = mixing.PRODUCTION) -> str:
    n, k = len(c.knots), c.knots
    weights = [f"CASE source {' '.join(f"WHEN '{s}' THEN {w[i]}" for s, w in c.weights.items())} ELSE {c.default[i]} END AS r{i}" for i in range(n)]
    areas = ["0.0::DOUBLE AS c0"]
    terms = []
    for i in range(1, n):
        terms.append(f"({float(k[i] - k[i - 1])}::DOUBLE * (w{i - 1} + w{i})) / 2.0::DOUBLE")
        areas.append(f"{' + '.join(terms)} AS c{i}")
    position = ""
    for i in range(n - 1):
        width = float(k[i + 1] - k[i])
        d = f"(x - c{i})"
        u = f"CASE WHEN {d} <= 0 THEN 0.0::DOUBLE ELSE (2.0::DOUBLE * {d}) / (w{i} + sqrt(greatest(w{i} * w{i} + 2.0::DOUBLE * ((w{i + 1} - w{i}) / {width}::DOUBLE) * {d}, 0.0::DOUBLE))) END"
        here = f"{float(k[i])}::DOUBLE + {u}"
        position += f"WHEN x < c{i + 1} THEN {here} " if i < n - 2 else f"ELSE {here} "
    return f"""
WITH d AS (
  SELECT doc_id, source, ('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '|mix')), 1, 15))::BIGINT AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0) AS BIGINT) AS n_tokens
  FROM documents),
s AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS supply, {', '.join(weights)} FROM d GROUP BY source HAVING sum(n_tokens) > 0),
z AS (SELECT {', '.join(f'sum(r{i}) AS z{i}' for i in range(n))} FROM s),
w AS (SELECT source, supply, {', '.join(f'CAST(r{i} AS DOUBLE) / CAST(z{i} AS DOUBLE) AS w{i}' for i in range(n))} FROM s, z),
c AS (SELECT *, {', '.join(areas)} FROM w),
t AS (SELECT max(supply / c{n - 1}) AS t FROM c WHERE c{n - 1} > 0),
p AS (
  SELECT doc_id, d.source, n_tokens, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY d.source ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) / t AS x0, least(x0, c{n - 1}) AS x, c.*
  FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source, t)
SELECT doc_id, source, n_tokens, round(CASE {position} END, 9) AS position FROM p WHERE c{n - 1} > 0
"""


def _sharding_sql(n: int = 64) -> str:
    return f"""
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
k AS (SELECT doc_id, sum(n_bytes) AS b FROM d GROUP BY doc_id),
p AS (SELECT doc_id, coalesce(sum(b) OVER (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM k)
SELECT d.doc_id, n_bytes, CAST(start AS BIGINT) AS byte_start,
       CAST(least(CAST(start AS BIGINT) * {n} // greatest((SELECT CAST(sum(n_bytes) AS BIGINT) FROM d), 1), {n - 1}) AS INTEGER) AS shard
FROM d JOIN p ON d.doc_id IS NOT DISTINCT FROM p.doc_id
"""


def _vectors_sql(threshold: float = 0.97) -> str:
    return f"""
WITH RECURSIVE e AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT v, min(vec_id) AS copy_id FROM e GROUP BY v),
near AS (SELECT a.copy_id AS a, b.copy_id AS b FROM s a JOIN s b ON len(a.v) = len(b.v) AND a.copy_id <> b.copy_id WHERE list_cosine_similarity(a.v, b.v) >= {threshold}),
reach AS (SELECT copy_id AS a, copy_id AS b FROM s UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
l AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT DISTINCT e.vec_id, c.class_id, s.copy_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM e JOIN s ON e.v = s.v JOIN c ON c.a = s.copy_id LEFT JOIN l ON l.a = s.copy_id
"""


def _repeats_sql(length: int = 50) -> str:
    return f"""
WITH d AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - {length - 1})) AS i FROM d WHERE len(w) >= {length}),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + {length}], ' ')) AS h FROM p),
k AS (SELECT h, min(doc_id) AS low FROM g GROUP BY h HAVING min(doc_id) <> max(doc_id)),
m AS (SELECT DISTINCT doc_id, i, doc_id = low AS first FROM g JOIN k USING (h)),
n AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id, first ORDER BY i) <= {length} THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, first ORDER BY i) AS island FROM n)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + {length} AS INTEGER) AS end_word, CAST(max(i) + {length} - min(i) AS INTEGER) AS n_words, first FROM s GROUP BY doc_id, first, island
"""


def _jaccard_sql(n: int = 3, threshold: float = 0.5) -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '(?:[0-9a-z]|[^\\x00-\\x7F])+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM w WHERE len(w) > 0),
t AS (SELECT s, min(doc_id) AS text_id, max(doc_id) AS last FROM g GROUP BY s),
x AS (SELECT text_id, len(s) AS size, unnest(s) AS gram FROM t),
near AS (SELECT a.text_id AS a, b.text_id AS b FROM x a JOIN x b ON a.gram = b.gram AND a.text_id <> b.text_id GROUP BY a.text_id, b.text_id, a.size, b.size HAVING count(*) >= {threshold} * (a.size + b.size - count(*))),
reach AS (SELECT text_id AS a, text_id AS b FROM t UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a),
l AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT DISTINCT g.doc_id, c.class_id, t.text_id, CAST(coalesce(l.n, 0) AS BIGINT) AS n_links
FROM g JOIN t ON g.s = t.s JOIN c ON c.a = t.text_id LEFT JOIN l ON l.a = t.text_id WHERE l.n IS NOT NULL OR t.text_id <> t.last
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": _mixing_sql(), "op2_ngram_jaccard": _jaccard_sql(), "op7_embedding_dedup": _vectors_sql(), "op8_warc_zip": "SELECT page_id, url, html FROM pages", "op9_suffix_dedup": _repeats_sql(), "op10_sharding": _sharding_sql()}
