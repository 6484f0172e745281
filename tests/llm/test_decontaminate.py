from collections import defaultdict

import numpy as np
import pyarrow as pa

from pipewright.llm import decontaminate
from tests.llm.helpers import DATA, SCHEMA, documents, odd, words

ITEM = "A train leaves Boston at 60 km per hour and another train leaves at 45 km per hour. How long until they meet if the cities are 210 km apart and nobody stops on the way?"
OTHER = "Which of the following substances is most likely to dissolve in cold water when stirred for several minutes without heating?"


def bench(spark, items=((1, ITEM), (2, OTHER))):
    return spark.createDataFrame(list(items), "item_id long, text string")


def found(spark, texts, **options):
    return sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contamination(documents(spark, texts), bench(spark), **options).collect())


def test_exact_and_reparameterised(spark):
    other_numbers = ITEM.replace("60", "72").replace("45", "38").replace("210", "440").replace("Boston", "Lisbon")
    inside = words(200, 1) + " " + OTHER + " " + words(100, 2)
    assert found(spark, [ITEM, other_numbers, inside, words(300, 3), OTHER.upper(), ITEM.title()]) == [(0, 1), (1, 1), (2, 2), (4, 2), (5, 1)]


def test_slots_must_be_consistent():
    t = decontaminate.Templates
    import pyarrow as pa

    a = t(pa.array(["add 5 and 5 to get 10 then take 5"]))
    same = t(pa.array(["add 7 and 7 to get 14 then take 7"]))
    other = t(pa.array(["add 7 and 8 to get 14 then take 9"]))
    assert decontaminate.compare(a.kind[0], a.template[0], a.value, same.template[0], same.value) == (10, 10)
    assert decontaminate.compare(a.kind[0], a.template[0], a.value, other.template[0], other.value)[1] < 10


def test_parts_agree_with_one_broadcast(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    one = sorted(tuple(r) for r in decontaminate.contamination(docs, items).collect())
    many = sorted(tuple(r) for r in decontaminate.contamination(docs, items, limit=2000).collect())
    assert one and one == many


def contaminated(text, items, n=8, literals=4, coverage=0.5, min_run=25):
    """Whether a text has one of the items: windows compared as tuples, all alignments that any of them gives tried."""
    doc = decontaminate.Templates(pa.array([text]))
    for item in items:
        own = decontaminate.Templates(pa.array([item]))
        hits = {True: set(), False: set()}  # sure or not: (form, diagonal)
        for form in (0, 1):
            m, kind = len(own.values[form]), own.kind[form]
            size = min(n, m)
            for exact, (x, y) in ((False, (own.template[form], doc.template[form])), (True, (own.values[form], doc.values[form]))):
                if not m or (not exact and size < 4):
                    continue
                places = defaultdict(list)
                for p in range(len(y) - size + 1):
                    places[tuple(y[p : p + size])].append(p)
                for p in range(m - size + 1):
                    rich = (kind[p : p + size] == 0).sum() * n >= literals * size
                    if not (exact and rich and size >= 4):
                        for at in places[tuple(x[p : p + size])]:
                            hits[exact or rich].add((form, at - p))
        sure = bool(hits[True])
        share = longest = 0
        for form in (0, 1):
            kind, values, template = own.kind[form], own.values[form], own.template[form]
            words = kind == 0
            weak = {d for f, d in hits[False] if f == form} - {d for f, d in hits[True] if f == form}
            if not sure and (not words.any() or np.isin(values[words], doc.values[form]).sum() < coverage * words.sum()):
                weak = set()
            total, run, pieces, seen = 0, 0, [], np.zeros(len(kind), dtype=bool)
            for d in weak | {d for f, d in hits[True] if f == form}:
                lo, hi = max(0, d), min(len(doc.values[form]), d + len(kind))
                stretch = decontaminate.runs(kind[lo - d : hi - d], template[lo - d : hi - d], values[lo - d : hi - d], doc.template[form][lo:hi], doc.values[form][lo:hi])
                stretch = [(x, k) for x, k in stretch if d not in weak or words[lo - d + x : lo - d + x + k].any()]
                for x, k in stretch:
                    if k >= 4:
                        pieces.append((lo - d + x, lo + x, k))
                        seen[lo - d + x : lo - d + x + k] = True
                    run = max(run, k)
                total = max(total, sum(k for _, k in stretch))
            if not len(kind) or (not sure and (not words.any() or seen[words].sum() < coverage * words.sum())):
                continue
            total = max(total, decontaminate.chain(pieces)) if pieces else total
            share, longest = max(share, total / len(kind)), max(longest, run)
        if share >= coverage or longest >= min_run:
            return True
    return False


def test_against_search_of_all_alignments(spark):
    """The documents found are exactly those in which a search without hashes finds an item."""
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet").collect(), [i["text"] for i in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    want = {d["doc_id"] for d in docs if d["text"] and contaminated(d["text"], items)}
    got = {r["doc_id"] for r in decontaminate.contamination(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert want and got == want


def test_join_of_windows_with_odd_keys(spark):
    """A benchmark above the limit, with null and repeated keys on both sides and items of all lengths."""
    items = bench(spark, [(1, ITEM), (1, ITEM), (None, OTHER), (3, "too short"), (4, None), (5, "Compute 12 + 7 * 5 - 3")])
    docs = documents(spark, [(1, ITEM), (1, ITEM), (None, "before " + OTHER), (3, "x too short y"), (4, None), (5, ""), (6, "Compute 9 + 8 * 7 - 6"), (7, words(90, 3))])
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    one = rows(decontaminate.contamination(docs, items))
    assert len(one) == 7 and rows(decontaminate.contamination(docs, items, limit=10)) == one


def test_odd_rows(spark):
    table = odd(spark)
    kept = decontaminate.decontaminate(table, bench(spark))
    assert kept.columns == table.columns and kept.count() == table.count()
    items = bench(spark, [(1, None), (2, ""), (None, words(40, 3)), (3, "too short")])
    got = sorted(r["doc_id"] for r in decontaminate.contamination(table, items).collect())
    assert got == [5, 5, 6]
    assert decontaminate.decontaminate(table, items).count() == table.count() - 3
    empty = spark.createDataFrame([], SCHEMA)
    assert decontaminate.contamination(empty, bench(spark)).count() == 0
    assert decontaminate.contamination(table, bench(spark, [(1, "x")]).limit(0)).count() == 0


def test_changed_token_counts(spark):
    """Decimals, separators, names of several words and inserted words change the number of tokens."""
    decimals = ITEM.replace("60", "62.5").replace("45", "47.5").replace("210", "1,210.5").replace("Boston", "New York")
    w = ITEM.split()
    inserted = " ".join([*w[:12], "indeed", *w[12:24], "really", *w[24:]])
    scattered = " ".join([*w[24:], *w[12:24], *w[:12]])
    assert found(spark, [decimals, inserted, words(50, 1) + " " + inserted + " " + words(50, 2), words(100, 3)], min_run=99) == [(0, 1), (1, 1), (2, 1)]
    assert found(spark, [scattered], min_run=99) == []
    import pyarrow as pa

    t = decontaminate.Templates(pa.array(["it costs 1,210.50 or 3 in New York, Old Town", "7"]))
    assert [len(v) for v in t.values] == [9, 11] and [f.tolist() for f in t.firsts] == [[0, 8, 9], [0, 10, 11]]


def test_longest_run_is_kept_beside_the_best_total(spark):
    item = words(60, 9).split()
    longer = item[34:]
    more = [*item[:10], "x", *item[11:20], "y", *item[21:29]]
    got = decontaminate.contamination(documents(spark, [" ".join([*longer, *words(40, 8).split(), *more])]), bench(spark, [(1, " ".join(item))])).collect()
    assert [(r["matched_tokens"], r["longest_run"]) for r in got] == [(27, 26)]


def test_chain():
    assert decontaminate.chain([(0, 0, 12), (12, 13, 12), (24, 26, 12)]) == 36
    assert decontaminate.chain([(0, 50, 12), (12, 13, 10)]) == 12
    assert decontaminate.chain([(0, 0, 10), (8, 9, 10)]) == 18


def test_number_dense_and_short_items(spark):
    items = bench(spark, [(1, "Compute 12 + 7 * 5 - 3 / 2"), (2, "What follows 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 22?"), (3, "blue whale"), (4, "3 5 8 13 21")])
    texts = ["so Compute 31 + 4 * 9 - 8 / 6 now", "What follows 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23?", "a blue whale", "blue or whale", " ".join(map(str, range(100, 400))), "3 5 8 13 21", "Compute 31 + 31 * 9 - 8 / 6"]
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contamination(documents(spark, texts), items).collect())
    assert got == [(0, 1), (1, 2), (2, 3), (5, 4)]
