import gzip
import json

from pipewright.engine import Engine


def test_frames(spark):
    e = Engine(spark)
    text = "datatable(a:long, t:datetime, s:timespan, r:real, d:dynamic)[1, datetime(2024-01-02), 1d, real(nan), dynamic({'x':1})] | sort by a asc | render table with (title='T')"
    one = e.frames(text, 1)
    assert one["Tables"][0]["Rows"] == [[1, "2024-01-02T00:00:00.0000000Z", "1.00:00:00", "NaN", '{"x":1}']]
    assert [c["ColumnType"] for c in one["Tables"][0]["Columns"]] == ["long", "datetime", "timespan", "real", "dynamic"]
    two = list(e.frames(text))
    assert [f.get("TableKind", f["FrameType"]) for f in two] == ["DataSetHeader", "QueryProperties", "PrimaryResult", "QueryCompletionInformation", "DataSetCompletion"]
    chart = json.loads(two[1]["Rows"][0][2])
    assert chart["Title"] == "T" and chart["IsQuerySorted"] and chart["Ymin"] == "NaN"
    parts = list(e.frames("range x from 1 to 12000 step 1", progressive=True))
    assert [len(f["Rows"]) for f in parts if f["FrameType"] == "TableFragment"] == [5000, 5000, 2000]
    json.dumps(two), json.dumps(parts)


def test_load(spark, tmp_path):
    with gzip.open(tmp_path / "a.csv.gz", "wt") as f:
        f.write("a,b\n1,x\n2,y\n")
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{"k": 2}\n')
    (tmp_path / "c.txt").write_text("one\ntwo\n")
    e = Engine(spark)
    e.load("A", str(tmp_path / "a.csv.gz"))
    e.load("B", str(tmp_path / "b.jsonl"))
    e.load("C", str(tmp_path / "c.txt"))
    assert e.query("A | summarize sum(a)").first()[0] == 3
    assert e.query("B | count").first()[0] == 2 and e.query("C | where value has 'two' | count").first()[0] == 1
