import itertools

import numpy as np
import pytest

from pipewright.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    out = set()
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if len(a) == len(b) and i != j:
            a64, b64 = np.asarray(a, np.float32).astype(float), np.asarray(b, np.float32).astype(float)
            if a64 @ b64 / np.sqrt((a64 @ a64) * (b64 @ b64)) >= threshold:
                out.add((min(i, j), max(i, j)))
    return out


def classes(rows, pairs):
    """{(key, class, copy, links)} of all rows, from all similar pairs."""
    vectors = {i: tuple(np.asarray(v, np.float32).tolist()) for i, v in rows}
    parent = {i: i for i in vectors}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = {i: set() for i in vectors}
    for a, b in sorted(pairs):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
        if vectors[a] != vectors[b]:
            near[a].add(vectors[b])
            near[b].add(vectors[a])
    first = {}
    for i in sorted(vectors):
        first.setdefault(vectors[i], i)
    return {(i, root(i), first[v], len(near[i])) for i, v in vectors.items()}


def found(df):
    rows = [tuple(r) for r in df.select("vec_id", "class_id", "copy_id", "n_links").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(n=300, dim=64, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = r.standard_normal(dim)
        for c in range(1 + k % 4):
            rows.append((len(rows), (base + c * r.uniform(0.05, 0.12) * r.standard_normal(dim)).astype(np.float32).tolist()))
    rows.append((len(rows), rows[0][1]))
    return rows


@pytest.mark.parametrize(("threshold", "dim"), [(0.97, 64), (0.9, 20), (0.99, 7)])
def test_no_pair_is_missed(spark, threshold, dim):
    rows = made(120, dim, dim)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = brute(rows, threshold)
    assert want and found(vectors.similar_vectors(table, threshold)) == classes(rows, want)


def test_hot_cells_and_large_components_in_tiles(spark, monkeypatch):
    """A third of all vectors are alike: their cells and their component are divided."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 16)
    monkeypatch.setattr(vectors, "_TILE_ROWS", 9)
    r = np.random.default_rng(3)
    base = r.standard_normal(24)
    near = [(1000 + k, (base + 0.08 * r.standard_normal(24)).astype(np.float32).tolist()) for k in range(60)]
    rows = made(50, 24, 4) + near + [(2000 + k, near[0][1]) for k in range(30)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    want = brute(rows, 0.97)
    assert len(want) > 1000 and found(vectors.similar_vectors(table)) == classes(rows, want)


def test_one_stays(spark):
    rows = made(40)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    kept = sorted(r["vec_id"] for r in vectors.deduplicate_vectors(table).collect())
    assert kept == sorted(i for i, c, _, _ in classes(rows, brute(rows, 0.97)) if i == c)


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, None), (2, v, 1), (None, v, 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1), (7, [float("nan"), 1.0, 1.0], 1), (8, [2.0, 4.0, 6.0], 1), (9, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "v", "key", "least", "ids", "cosine", "__gone"):
        table = table.withColumn(name, F.lit(0))
    assert found(vectors.similar_vectors(table)) == {(1, 1, 1, 1), (2, 1, 1, 1), (8, 1, 8, 1), (9, 9, 9, 0)}
    kept = vectors.deduplicate_vectors(table)
    assert kept.columns == table.columns
    assert sorted(r["vec_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 9]
    assert vectors.similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        vectors.similar_vectors(table, 0.0)
