import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pipewright.llm import jaccard
from pipewright.llm._shared import grouped_arrow
from pipewright.llm.components import tiles
from tests.llm.helpers import DATA, SCHEMA, documents, odd, words


def grams(text, n=3):
    w = re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", text.lower())
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.5):
    sets = {}
    for k, t in rows:
        if k is not None and t and grams(t):
            sets[k] = grams(t)
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def links(pairs, rows):
    """{(doc, class, text, links)} of the documents with a similar one, from all similar pairs."""
    sets = {k: grams(t) for k, t in rows if k is not None and t and grams(t)}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    near = {k: set() for k in sets}
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
        if sets[a] != sets[b]:
            near[a].add(sets[b])
            near[b].add(sets[a])
    first = {}
    for k in sorted(sets):
        first.setdefault(sets[k], k)
    linked = {k for p in pairs for k in p}
    return {(k, root(k), first[sets[k]], len(near[k])) for k in linked}


def found(df):
    return {tuple(r) for r in df.select("doc_id", "class_id", "text_id", "n_links").collect()}


def recall(got, want):
    """Share of the links that were found; nothing may be found that is not there."""
    most = {(k, t): n for k, _, t, n in want}
    assert all(n <= most[k, t] for k, _, t, n in got)
    return sum(n for *_, n in got) / sum(n for *_, n in want)


def family(seed, n=60):
    """Texts that differ from one another by more and more words."""
    base = words(n, seed).split()
    out = [" ".join(base)]
    for k in range(1, 9):
        out.append(" ".join(f"x{seed}{k}{i}" if i % 9 < 1 and i < 7 * k else w for i, w in enumerate(base)))
    return out


def test_recall_and_precision(spark):
    texts = [t for s in range(25) for t in family(s)]
    rows = list(enumerate(texts))
    got, want = found(jaccard.similar(documents(spark, texts))), links(brute(rows), rows)
    assert want and recall(got, want) >= 0.97


def test_real_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got, want = found(jaccard.similar(docs)), links(brute(rows), rows)
    assert recall(got, want) >= 0.97 and len(got & want) >= 0.97 * len(want)


def test_large_nodes_split_and_end_in_tiles(spark):
    """Groups of alike texts far above the limit of a node reach the last level and are searched in tiles."""
    texts = [t for s in range(12) for t in family(s)] + [words(50, 99)] * 40 + [f"{words(60, 98)} tail{k}" for k in range(60)]
    rows = list(enumerate(texts))
    got, want = found(jaccard.similar(documents(spark, texts), node_limit=4)), links(brute(rows), rows)
    assert recall(got, want) >= 0.97
    tails = {r for r in got if r[0] >= 148}
    assert tails == {r for r in want if r[0] >= 148} and all(r[3] == 59 for r in tails)


def test_large_components_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_TILE_SETS", 7)
    texts = [f"{words(60, 98)} tail{k}" for k in range(50)] + [t for s in range(4) for t in family(s)]
    rows = list(enumerate(texts))
    got, want = found(jaccard.similar(documents(spark, texts))), links(brute(rows), rows)
    assert recall(got, want) >= 0.97
    assert {r for r in got if r[0] < 50} == {r for r in want if r[0] < 50}


@pytest.mark.parametrize("block", [5, 1 << 15])
def test_large_components_are_parted_below_the_threshold(spark, monkeypatch, block):
    """Texts that share a line are like one another below the threshold: they must not be compared all with all."""
    monkeypatch.setattr(jaccard, "_TILE_SETS", 7)
    monkeypatch.setattr(jaccard, "_BITMAP_SETS", block, raising=False)
    line = words(22, 97)
    texts = [f"{line} {words(22, 300 + k)}" for k in range(60)] + [f"{line} {words(22, 300 + k)} end{k}" for k in range(5)] + family(3)
    rows = list(enumerate(texts))
    want = links(brute(rows), rows)
    join = jaccard._Join(documents(spark, texts), 3, 0.5, 0.98, 1024, "doc_id", "text")
    assert max(r["count"] for r in join.groups.groupBy("component").count().collect()) < 30
    got = {tuple(r) for r in join.members().select("d", "class_id", "text_id", "n_links").collect()}
    assert {r for r in got if r[0] < 65} == {r for r in want if r[0] < 65} and recall(got, want) >= 0.97


def test_bitmaps_lose_no_similar_pair():
    r = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = r.integers(0, 1 << 63, int(r.integers(1, 400)), dtype=np.uint64)
        sets += [np.unique(np.r_[base[r.random(len(base)) < keep], r.integers(0, 1 << 63, 3, dtype=np.uint64)]) for keep in (1, 0.8, 0.6, 0.5)]
    sets.sort(key=len)
    size, bits = np.array([len(s) for s in sets], dtype=np.float64), np.array([jaccard.bitmap(s) for s in sets])
    i, j = jaccard._verify(sets, 0.5)
    for block in (1, 50, 1 << 17):
        every = np.arange(len(sets))
        inner = jaccard._merge_near(every, bits, size, every, every, 0.5, block)
        cross = jaccard._merge_near(every, bits, size, every[::2], every[1::2], 0.5, block)
        other = i % 2 != j % 2
        assert len(i) > 40 and (inner[i] == inner[j]).all() and (cross[i[other]] == cross[j[other]]).all() and len(np.unique(inner)) > 20


@pytest.mark.parametrize("blocks", [1, 2, 3, 5])
def test_tiles_hold_every_pair_once(spark, blocks):
    rows = tiles(spark.range(40).withColumn("name", F.lit(7)).withColumn("blocks", F.lit(blocks).cast("long")), "name", "id", "blocks").collect()
    seen = Counter()
    for tile in {r["tile"] for r in rows}:
        for a, b in itertools.combinations(sorted((r for r in rows if r["tile"] == tile), key=lambda r: r["id"]), 2):
            if a["side"] != b["side"] or a["own"]:
                seen[a["id"], b["id"]] += 1
    assert seen == Counter(itertools.combinations(range(40), 2))


def test_runs_reach_the_recall_at_any_depth():
    for depth in range(1, jaccard.DEPTH + 1):
        p = jaccard.survival(0.5, depth)
        assert 1 - (1 - p) ** jaccard.runs_for(0.5, 0.99, depth) >= 0.99


def test_groups_stay_whole_over_batches():
    keys = sorted(random.Random(1).choices(range(30), k=500)) + [99] * 700 + [100, 101]
    for size in (1, 7, 64, 2000):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[k : k + size])], names=["k"]) for k in range(0, len(keys), size)]
        tables = [t.column("k").to_pylist() for t in grouped_arrow(iter(batches), "k", 20)]
        assert sum(tables, []) == keys and all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))


def test_one_stays(spark):
    texts = family(1)[:3] + family(2)[:3] + [words(60, 50), "only", ""]
    kept = sorted(r["doc_id"] for r in jaccard.deduplicate(documents(spark, texts)).collect())
    assert kept == [0, 3, 6, 7, 8]


def test_odd_rows(spark):
    table = odd(spark)
    assert found(jaccard.similar(table)) == {(5, 5, 5, 0), (6, 5, 5, 0)}
    kept = jaccard.deduplicate(table)
    assert kept.columns == table.columns
    ids = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 5, 7, 7]
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.similar(empty).count() == 0 and jaccard.deduplicate(empty).count() == 0
