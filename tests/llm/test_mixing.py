import hashlib
import math
from collections import defaultdict

import duckdb
import pytest

from pipewright.llm import mixing, queries
from tests.llm.helpers import DATA, SCHEMA, documents, odd


def brute(rows, c=mixing.PRODUCTION, budget=None, whole=False):
    """Positions by numeric inversion of each source's cumulative demand."""
    supply = defaultdict(int)
    for _, s, n in rows:
        supply[s] += n
    supply = {s: n for s, n in supply.items() if n > 0}
    at = lambda s: c.weights.get(s, c.default)
    totals = [sum(at(s)[i] for s in supply) for i in range(len(c.knots))]

    def demand(s, t):
        area = 0.0
        for i in range(len(c.knots) - 1):
            a, b = c.knots[i], c.knots[i + 1]
            w0, w1 = at(s)[i] / totals[i], at(s)[i + 1] / totals[i + 1]
            u = min(max(t - a, 0.0), b - a)
            area += w0 * u + (w1 - w0) / (b - a) * u * u / 2
        return area

    budget = budget or (max if whole else min)(supply[s] / demand(s, 1.0) for s in supply if demand(s, 1.0) > 0)
    out = {}
    digest = lambda k: int(hashlib.md5(f"{'' if k is None else k}|mix".encode()).hexdigest()[:15], 16)
    for s in supply:
        seen = 0
        for k, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: digest(r[0])):
            if whole or seen / budget < demand(s, 1.0):
                lo, hi = 0.0, 1.0
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (mid, hi) if demand(s, mid) < seen / budget else (lo, mid)
                out[k] = hi if seen else 0.0
            seen += n
    return out


def test_against_inversion(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r["position"] for r in mixing.mix(docs, rows_per_bucket=17, whole=False).collect()}
    rows = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in docs.collect()]
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-6) for k in got)


def test_order_and_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    positions = [r["position"] for r in mixing.mix(docs).collect()]
    assert positions == sorted(positions)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op1_mixing"]).fetchall())
    got = sorted((r["doc_id"], r["source"], r["n_tokens"], r["position"]) for r in mixing.mix(docs).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(math.isclose(g[3], w[3], abs_tol=2e-9) for g, w in zip(got, want))


def test_odd_rows(spark):
    table = odd(spark)
    out = mixing.mix(table, carry=table.columns)
    assert set(out.columns) == {*table.columns, "n_tokens"}
    assert all(0 <= r["position"] <= 1 for r in out.collect())
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(documents(spark, ["", None])).count() == 0
    c = mixing.Curriculum(weights={"a": (0, 0, 0)}, default=(1, 1, 1))
    assert mixing.mix(documents(spark, ["x y"]), c).count() == 0


def test_budget_and_bad_schedules(spark):
    docs = documents(spark, ["a b c d"] * 10)
    assert mixing.mix(docs, budget=8).count() == 2
    with pytest.raises(ValueError):
        mixing.Curriculum(knots=(0.0, 0.0, 1.0))
    with pytest.raises(ValueError):
        mixing.Curriculum(default=(1, -1, 1))


def test_whole_leaves_nothing_out(spark):
    rare = documents(spark, ["a b c d"] * 10).union(documents(spark, [(100, "x y"), (101, "")], source="rare")).union(documents(spark, [(200, "z"), (201, "z z")], source=None))
    assert mixing.mix(rare, whole=False).count() < 14
    got = {r["doc_id"]: r["position"] for r in mixing.mix(rare).collect()}
    assert sorted(got) == [*range(10), 100, 101, 200, 201] and all(0 <= p <= 1 for p in got.values())
    # Shares of a third each: the largest source fills the budget, the others run out after 2 and 3 of 40 tokens.
    assert max(got[k] for k in (101, 200, 201)) < 0.1 and max(got[k] for k in range(10)) > 0.85
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert queries.op1_mixing(spark, DATA).count() == docs.count()
