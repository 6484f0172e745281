import random

from pipewright.llm import _shared, html
from pipewright.llm.html import Node

SCHEMA = "page_id long, url string, html string"


def page(k, body, nav="Home About"):
    return f"<html><head><title>Page {k}</title><script>var x='<p>no</p>';</script></head><body><div class='top'>Example Site</div><nav>{nav}</nav><main><h1>Story {k}</h1>{body}</main><div class='foot'>All rights reserved</div></body></html>"


def naive(a, b):
    """Simple tree matching by its definition."""
    if a.label != b.label:
        return 0
    m, n = len(a.children), len(b.children)
    t = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m):
        for j in range(n):
            t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + naive(a.children[i], b.children[j]))
    return t[m][n] + 1


def random_tree(r, depth=3):
    n = Node("x", r.choice("abc"), False)
    if depth:
        n.children = [random_tree(r, depth - 1) for _ in range(r.randint(0, 4))]
    return n


def test_matching_is_optimal():
    r = random.Random(3)
    for _ in range(300):
        a, b = random_tree(r), random_tree(r)
        a.label = b.label = "root"
        html._shape(a)
        html._shape(b)
        pairs = html.matching(a, b)
        assert html.weight(a, b, {}) == naive(a, b) == len(pairs)
        assert all(p.label == q.label for p, q in pairs)


def test_deep_and_broken_sources():
    deep = html.parse("<div>" * 5000 + "x" + "</div>" * 5000)
    assert html.preorder(deep)[-1].text == "x"
    broken = html.parse("<p>one<p>two<ul><li>a<li>b</ul><b>bold</p> tail < 3 &amp; <img src='a>b'> end<!-- c")
    assert [n.text for n in html.preorder(broken) if n.text] == ["bold tail < 3 & end", "one", "two", "a", "b"]


def test_template_and_content(spark):
    rows = [(k, f"https://site.org/{k}", page(k, f"<p>Text number {k} of the site.</p>" * (1 + k % 3))) for k in range(6)]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k in range(6):
        assert got[k]["content"].split("\n") == [f"Story {k}", *[f"Text number {k} of the site."] * (1 + k % 3)]
        assert got[k]["title"] == f"Page {k}" and got[k]["n_template"] == 3 and got[k]["host"] == "site.org"


def test_result_does_not_depend_on_order(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a = sorted(tuple(map(str, r)) for r in html.extract(pages).collect())
    b = sorted(tuple(map(str, r)) for r in html.extract(pages.repartition(5).orderBy("url"), limit=1).collect())
    assert a == b and len(a) == pages.count()


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, page(1, "<p>alone</p>")), (2, "http://a.org/", None), (3, "http://a.org/x", ""), (4, "not an address", "plain words"), (None, "http://a.org/y", page(5, "<p>" + "long " * 200_000 + "</p>")), (6, "http://b.org", page(6, "<p>x</p>")), (6, "http://b.org", page(6, "<p>x</p>"))]
    table = spark.createDataFrame(rows, SCHEMA)
    for name in ("k", "t", "host", "h", "pivot", "title", "content"):
        table = table.withColumn(name, F.lit("z"))
    got = html.extract(table).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 7 and by[2]["content"] is None and by[3]["content"] == "" and by[4]["content"] == "plain words" and by[4]["host"] is None
    assert len(by[None]["content"]) > 900_000 and sum(r["page_id"] == 6 for r in got) == 2 and by[6]["n_template"] == 0
    assert html.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_each_layout_has_its_wrapper(spark):
    """Boilerplate of both layouts of a host is template, whichever page has the smallest hash."""
    story = lambda k: f"<html><body><div class='lead'><p>Daily news of the town</p></div><div class='story'><p>Story {k} alone</p></div></body></html>"
    listing = lambda k: f"<html><body><section class='top'><p>All entries by year</p></section><section class='rows'><ul><li>Entry {k} first</li><li>Entry {k} second</li></ul></section></body></html>"
    odd = "<html><body><table><tr><td>Please log in</td></tr></table></body></html>"
    rows = [(k, f"http://two.org/{k}", story(k) if k % 2 else listing(k)) for k in range(12)] + [(12, "http://two.org/login", odd)]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k in range(12):
        assert got[k]["content"] == (f"Story {k} alone" if k % 2 else f"Entry {k} first\nEntry {k} second") and got[k]["n_template"] == 1
    assert got[12]["content"] == "Please log in" and got[12]["n_template"] == 0


def test_sources_are_not_written(spark, tmp_path, monkeypatch):
    """The intermediate tables hold the pages' texts, not their markup and scripts."""
    r = random.Random(4)
    script = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=20_000))
    rows = [(k, f"http://big.org/{k}", f"<html><body><script>{script()}</script><div class='top'>Example Site</div><p>Text {k}</p></body></html>") for k in range(60)]
    monkeypatch.setattr(_shared, "shared_dir", lambda spark: f"file://{tmp_path}")
    got = {x["page_id"]: x for x in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[k]["content"] == f"Text {k}" and got[k]["n_template"] == 1 for k in range(60))
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.3 * sum(len(x[2]) for x in rows)
