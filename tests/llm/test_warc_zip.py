import io
import zipfile

import pytest

from pipewright.llm import warc_zip

SCHEMA = "page_id long, url string, html string"


def records(n=5):
    return [(f"http://a.org/{k}", warc_zip.record(f"http://a.org/{k}", str(k), f"héllo {k}\r\n\r\n" * (k + 1))) for k in range(n)]


def bodies(path):
    f, _ = warc_zip.open_file(str(path))
    with f:
        return sorted(warc_zip.parse_record(warc_zip._read(f, o, n))["body"] for _, o, n in warc_zip.records_of(str(path)))


WANT = sorted(f"héllo {k}\r\n\r\n" * (k + 1) for k in range(5))


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("prefix", [b"", b"#!/bin/sh\n"])
def test_directory(tmp_path, zip64, prefix):
    path = tmp_path / "a.wacz"
    path.write_bytes(prefix + warc_zip.package(records(), zip64))
    assert bodies(path) == WANT
    f, size = warc_zip.open_file(str(path))
    theirs = {i.filename: i.file_size for i in zipfile.ZipFile(path).infolist()}
    assert {m.name: m.size for m in warc_zip.directory(f, size)} == theirs


def test_many_members_need_zip64(tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(66_000):
            z.writestr(zipfile.ZipInfo(f"n/{k}"), b"")
    f, size = warc_zip.open_file(str(path))
    assert len(warc_zip.directory(f, size)) == 66_000


def test_comment_without_index_and_compressed(tmp_path):
    raw = b"".join(r for _, r in records())
    path = tmp_path / "b.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/one.warc.gz", raw)
        z.writestr("archive/two.warc", warc_zip._inflated(raw))
        z.writestr("archive/packed.warc.gz", raw, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 looks like the end " + bytes(30)
    assert bodies(path) == sorted(WANT * 2)
    f, size = warc_zip.open_file(str(path))
    assert {m.name: m.offset >= 0 for m in warc_zip.directory(f, size)} == {"archive/one.warc.gz": True, "archive/two.warc": True, "archive/packed.warc.gz": False}


def test_damage(tmp_path):
    good = warc_zip.package(records())
    for data in (b"", b"no archive at all", good[:-30], good[:100]):
        path = tmp_path / "bad.zip"
        path.write_bytes(data)
        with pytest.raises(warc_zip.PackageError):
            list(warc_zip.records_of(str(path)))
    r = warc_zip.parse_record(warc_zip.record("u", "1", "body").replace(b"", b""))
    assert r["intact"] is True
    plain = warc_zip._inflated(warc_zip.record("u", "1", "body"))
    assert warc_zip.parse_record(plain.replace(b"\r\n\r\nbody", b"\r\n\r\nbodi"))["intact"] is False
    assert list(warc_zip.index_entries(b"!meta {}\nkey 2024 {broken\nkey 2024 {\"filename\":\"f\",\"offset\":\"3\",\"length\":4}\n")) == [("f", 3, 4)]
    assert zipfile.ZipFile(io.BytesIO(good)).testzip() is None


def test_ranges_are_split(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.wacz").write_bytes(warc_zip.package(records()))
    (tmp_path / "none.wacz").write_bytes(warc_zip.package([]))
    paths = warc_zip.packages(spark, f"file://{tmp_path}")
    assert paths.count() == 3
    got = warc_zip.read(paths.select("path").union(paths.select("path")), range_bytes=300)
    assert sorted(r["body"] for r in got.collect()) == sorted(WANT * 2)
    assert all(r["intact"] and r["status"] == 200 for r in got.collect())


def test_round_trip_of_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, "<p>x</p>"), (None, "http://a/", "y"), (2, "http://a/", None), (3, "", ""), (4, "http://a/ b\r\nX: y", "é" * 500_000), (5, "u", "same"), (5, "u", "same")]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("path", F.lit(1)).withColumn("body", F.lit(2))
    back = warc_zip.round_trip(table)
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, rows))
    assert warc_zip.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
