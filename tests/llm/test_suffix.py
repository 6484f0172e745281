import random
from collections import defaultdict

import numpy as np
import pytest

from pipewright.llm import suffix
from tests.llm.helpers import DATA, SCHEMA, documents, odd, words


def brute(rows, length):
    """{(doc, start, end, first)} from a dictionary of all windows."""
    docs = {}
    for k, t in rows:
        if k is not None and t:
            docs.setdefault(k, set()).add(tuple(t.split()))
    where = defaultdict(set)
    for k, texts in docs.items():
        for w in texts:
            for i in range(len(w) - length + 1):
                where[w[i : i + length]].add((k, i))
    hit = defaultdict(set)
    for places in where.values():
        least = min(k for k, _ in places)
        if len({k for k, _ in places}) > 1:
            for k, i in places:
                hit[k, k == least] |= set(range(i, i + length))
    out = set()
    for (k, first), covered in hit.items():
        for i in sorted(covered):
            if i - 1 not in covered:
                end = i
                while end in covered:
                    end += 1
                out.add((k, i, end, first))
    return out


def got(df):
    return {(r["doc_id"], r["start_word"], r["end_word"], r["first"]) for r in df.collect()}


@pytest.mark.parametrize(("length", "gram"), [(10, 5), (8, 8), (12, 1), (50, 25)])
def test_all_windows(spark, length, gram):
    r = random.Random(length)
    shared = [words(r.randint(length, 3 * length), 100 + k) for k in range(6)]
    texts = [" ".join([words(r.randint(0, 60), k), r.choice(shared), words(r.randint(0, 60), 200 + k), r.choice(shared)]) for k in range(40)]
    assert got(suffix.repeats(documents(spark, texts), length, gram, shards=5)) == brute(list(enumerate(texts)), length)


def test_hot_anchors_are_counted(spark):
    """Passages that many documents share are found by counting windows, with the same result."""
    r = random.Random(4)
    passage = words(40, 500)
    texts = [" ".join([words(r.randint(0, 60), k), passage, words(r.randint(0, 30), 200 + k)]) for k in range(60)] + [words(80, 7)] * 2
    assert got(suffix.repeats(documents(spark, texts), 10, 5, hot=50)) == brute(list(enumerate(texts)), 10)


@pytest.mark.parametrize("length", [1, 2, 5, 8])
def test_suffix_order_and_shared_prefixes(length):
    r = np.random.default_rng(length)
    codes = r.integers(1, 4, 600).astype(np.uint32)
    at = r.permutation(600 - length)[:300]
    order, shared = suffix.suffix_order(codes, at, length)
    suffixes = [tuple(codes[a : a + length]) for a in at[order]]
    assert suffixes == sorted(suffixes) and sorted(order) == list(range(300))
    for k in range(1, 300):
        n = next((i for i in range(length) if suffixes[k][i] != suffixes[k - 1][i]), length)
        assert shared[k] == n


def test_family_merges_geometrically():
    r, length = np.random.default_rng(1), 4
    family, places, where = suffix.Family(length), 0, defaultdict(set)
    for k in range(60):
        sizes = r.integers(length, 12, 9)
        codes, docs, firsts = r.integers(1, 5, sizes.sum()).astype(np.uint32), r.integers(0, 40, 9), r.integers(0, 100, 9).astype(np.int32)
        ends = np.cumsum(sizes)
        family.add(codes, ends, docs, firsts)
        for e, n, d, f in zip(ends, sizes, docs, firsts):
            for i in range(n - length + 1):
                where[tuple(codes[e - n + i : e - n + i + length])].add((int(d), int(f + i)))
                places += 1
    sizes = [len(x) for x in family.levels]
    assert len(sizes) > 1 and sum(sizes) == places and all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))
    for level in [*family.levels, family.whole()]:
        entries = [tuple(level.codes[a : a + length]) for a in level.at]
        assert entries == sorted(set(entries)) and (level.lcp < length).all()
    level = family.whole()
    for a, low, high, k in zip(level.at, level.low, level.high, range(len(level.at))):
        there = where[tuple(level.codes[a : a + length])]
        assert (low, high) == (min(d for d, _ in there), max(d for d, _ in there))
        own = level.entry == k
        assert set(zip(level.doc[own].tolist(), level.pos[own].tolist())) == there


def test_index_takes_further_batches(spark, tmp_path):
    r = random.Random(9)
    shared = [words(r.randint(10, 30), 100 + k) for k in range(6)]
    texts = [" ".join([words(r.randint(0, 60), k), r.choice(shared), words(r.randint(0, 60), 200 + k), r.choice(shared)]) for k in range(40)]
    rows = list(enumerate(texts))
    for a, b in ((0, 25), (25, 32), (32, 40)):
        index = suffix.SuffixIndex(spark, f"file://{tmp_path}/index", 10, 5, 6)  # as another session would open it
        new = got(index.add(documents(spark, rows[a:b])))
        assert new == {x for x in brute(rows[:b], 10) if a <= x[0]}
        assert got(index.repeats()) == brute(rows[:b], 10)
    assert got(index.add(documents(spark, []))) == set() and got(index.repeats()) == brute(rows, 10)
    assert suffix.SuffixIndex(spark, f"file://{tmp_path}/none").repeats().count() == 0


def test_long_texts_come_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_CODES", 64)
    texts = [words(900, k // 2) for k in range(4)]
    assert got(suffix.repeats(documents(spark, texts), 10, 5)) == brute(list(enumerate(texts)), 10)


def test_real_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert got(suffix.repeats(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], 50)


def test_odd_rows(spark):
    table = odd(spark)
    assert got(suffix.repeats(table, 20, 10)) == {(5, 0, 40, True), (6, 0, 40, False)}
    assert suffix.repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        suffix.repeats(table, 5, 6)
