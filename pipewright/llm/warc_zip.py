"""Web archives in ZIP packages, read in place.

A package holds stored (uncompressed) members: WARC files whose records are gzip members of their own, and CDXJ
indexes of them.  The reader parses the package's central directory (ZIP64 included), finds the members' bytes, and
range-reads single records; nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pipewright import ship
from pipewright.llm._shared import shared_dir, written

_EOCD, _EOCD64, _LOCATOR, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_ALL16, _ALL32 = 0xFFFF, 0xFFFFFFFF
#: Bytes of one range read; records are never split.
RANGE_BYTES = 4 << 20


class PackageError(ValueError):
    """The bytes are no readable package."""


@dataclass(frozen=True)
class Member:
    """``offset``: first byte of the data, -1 for members that are not stored or are encrypted."""

    name: str
    method: int
    size: int
    offset: int


def open_file(uri: str):
    """A random-access file on whatever file system the address names, and its size."""
    fs, path = pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)
    f = fs.open_input_file(path)
    return f, f.size()


def _read(f, offset: int, n: int) -> bytes:
    f.seek(offset)
    out = f.read(n)
    if len(out) != n:
        raise PackageError("the package is cut short")
    return out


def directory(f, size: int) -> list[Member]:
    """The members of a package, from its central directory; bytes before the archive are allowed."""
    tail_size = min(size, 22 + _ALL16)
    tail = _read(f, size - tail_size, tail_size)
    at = len(tail) - 22
    while at >= 0:
        at = tail.rfind(_EOCD, 0, at + 4)
        # The comment's length must lead to the end of the file, else the signature is part of the comment.
        if at < 0 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise PackageError("no end of central directory")
    position = size - tail_size + at
    disk, cd_disk, _, entries, cd_size, cd_offset = struct.unpack_from("<4H2I", tail, at + 4)
    end = position
    if _ALL16 in (disk, cd_disk, entries) or _ALL32 in (cd_size, cd_offset):
        if position >= 20:
            locator = _read(f, position - 20, 20)
            if locator[:4] == _LOCATOR:
                where = struct.unpack_from("<Q", locator, 8)[0]
                record = None
                # The locator's offset does not count bytes before the archive: look right before the locator too.
                for place in (where, position - 20 - 56):
                    if 0 <= place <= position - 76 and (record := _read(f, place, 56))[:4] == _EOCD64:
                        end = place
                        break
                    record = None
                if record is None:
                    raise PackageError("no ZIP64 end of central directory")
                disk, cd_disk, _, entries, cd_size, cd_offset = struct.unpack_from("<2I4Q", record, 16)
    if disk or cd_disk:
        raise PackageError("a package in several parts cannot be read")
    shift = end - cd_size - cd_offset
    if shift < 0:
        raise PackageError("the central directory is outside the file")
    raw = _read(f, cd_offset + shift, cd_size)
    out, p = [], 0
    for _ in range(entries):
        if raw[p : p + 4] != _ENTRY:
            raise PackageError("a central directory entry is damaged")
        flags, method = struct.unpack_from("<2H", raw, p + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<2I3H", raw, p + 20)
        (local,) = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = raw[p + 46 + n_name : p + 46 + n_name + n_extra]
        packed, plain, local = _zip64(extra, packed, plain, local)
        p += 46 + n_name + n_extra + n_comment
        offset = -1
        if method == 0 and not flags & 1:
            head = _read(f, local + shift, 30)
            if head[:4] != _LOCAL:
                raise PackageError(f"no local header for {name}")
            offset = local + shift + 30 + sum(struct.unpack_from("<2H", head, 26))
            if offset + packed > size:
                raise PackageError(f"{name} goes beyond the file")
        out.append(Member(name, method, packed if method == 0 else plain, offset))
    return out


def _zip64(extra: bytes, packed: int, plain: int, local: int) -> tuple[int, int, int]:
    """Sizes and offset, with those that did not fit taken from the extra field, in its fixed order."""
    k = 0
    while k + 4 <= len(extra):
        kind, n = struct.unpack_from("<2H", extra, k)
        if kind == 1:
            body, at = extra[k + 4 : k + 4 + n], 0
            if plain == _ALL32:
                plain, at = struct.unpack_from("<Q", body, at)[0], at + 8
            if packed == _ALL32:
                packed, at = struct.unpack_from("<Q", body, at)[0], at + 8
            if local == _ALL32:
                local = struct.unpack_from("<Q", body, at)[0]
        k += 4 + n
    return packed, plain, local


def _is_archive(name: str) -> bool:
    return name.lower().endswith((".warc", ".warc.gz"))


def _is_index(name: str) -> bool:
    return name.lower().endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz"))


def _inflated(data: bytes) -> bytes:
    """All gzip members of ``data``."""
    out = []
    while data:
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data if d.eof else b""
    return b"".join(out)


def index_entries(text: bytes) -> Iterator[tuple[str, int, int]]:
    """(file, offset, length) of each line ``key timestamp {json}``; lines without them are passed over."""
    for line in text.splitlines():
        brace = line.find(b"{")
        if brace < 0 or line.startswith(b"!"):
            continue
        try:
            entry = json.loads(line[brace:])
            yield str(entry["filename"]), int(entry["offset"]), int(entry["length"])
        except (ValueError, KeyError, TypeError):
            continue


def _walk(f, m: Member, chunk: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(offset, length) of the records of an archive without index: gzip members one after the other, or plain
    records by their Content-Length.  Reads the archive once, a chunk at a time."""
    at = 0
    if not m.name.lower().endswith(".gz"):
        while at < m.size:
            head = _read(f, m.offset + at, min(1 << 16, m.size - at))
            stop = head.find(b"\r\n\r\n")
            if stop < 0:
                return
            n = next((int(x.split(b":", 1)[1]) for x in head[:stop].split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
            yield at, min(stop + 8 + n, m.size - at)
            at += stop + 8 + n
        return
    while at < m.size:
        d, start = zlib.decompressobj(31), at
        while not d.eof and at < m.size:
            part = _read(f, m.offset + at, min(chunk, m.size - at))
            d.decompress(part)
            at += len(part) - len(d.unused_data)
        if not d.eof:
            return
        yield start, at - start


def records_of(uri: str) -> Iterator[tuple[str, int, int]]:
    """(member, absolute offset, length) of every record in the package's stored archives: from its indexes, and by
    walking the archives that no index names."""
    f, size = open_file(uri)
    with f:
        members = directory(f, size)
        archives = {m.name: m for m in members if m.offset >= 0 and _is_archive(m.name)}
        short = {n.rsplit("/", 1)[-1]: n for n in archives}
        seen: dict[str, set[tuple[int, int]]] = {}
        for m in members:
            if m.offset < 0 or not _is_index(m.name):
                continue
            raw = _read(f, m.offset, m.size)
            for name, offset, length in index_entries(_inflated(raw) if m.name.lower().endswith(".gz") else raw):
                full = name if name in archives else short.get(name.rsplit("/", 1)[-1])
                if full is not None and 0 <= offset and 0 < length and offset + length <= archives[full].size:
                    seen.setdefault(full, set()).add((offset, length))
        for name, m in archives.items():
            found = sorted(seen[name]) if name in seen else _walk(f, m)
            for offset, length in found:
                yield name, m.offset + offset, length


_RECORD = "package string, member string, offset long, length long, warc_type string, url string, date string, record_id string, row_key string, status int, body string, intact boolean"


def parse_record(raw: bytes) -> dict:
    """The fields of one record's bytes, gzipped or plain."""
    data = _inflated(raw) if raw[:2] == b"\x1f\x8b" else raw
    head, _, block = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        headers[k.strip().lower()] = v.strip()
    n = int(headers.get("content-length", len(block)))
    block = block[:n]
    status, body = None, block
    if headers.get("content-type", "").startswith("application/http"):
        http, _, body = block.partition(b"\r\n\r\n")
        words = http.split(b"\r\n", 1)[0].split()
        status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
    digest = headers.get("warc-payload-digest")
    url = headers.get("warc-target-uri")
    if "x-target-uri-json" in headers:
        url = json.loads(headers["x-target-uri-json"])
    return {
        "warc_type": headers.get("warc-type"), "url": url, "date": headers.get("warc-date"), "record_id": headers.get("warc-record-id"), "row_key": headers.get("x-row-key"), "status": status,
        "body": None if headers.get("warc-type") == "metadata" and headers.get("x-null-payload") else body.decode("utf-8", "replace"), "intact": None if digest is None else digest == _digest(body),
    }


def _digest(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def packages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the packages in a folder; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{wacz,zip}").option("recursiveFileLookup", True).load(folder).select("path", "length")


def read(paths: DataFrame, range_bytes: int = RANGE_BYTES, parts: int | None = None) -> DataFrame:
    """One row for each record of the packages named by ``paths`` (column ``path``; nulls and repeats are dropped).

    Directories and indexes are read first and give ranges of neighbouring records, at most ``range_bytes`` long (a
    longer record is a range of its own); the ranges are dealt out evenly and read one request each.  So a large
    package is read by many tasks.  ``intact`` says whether the payload has its recorded digest (null without one).

    Members that are compressed by ZIP or encrypted are not read; a file that is no package is an error.  Archives
    that no index names are walked once to find their records.  Packages without records give no rows.
    """
    ship(paths.sparkSession)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                rows: list[tuple] = []
                first = last = None
                name, held = None, []
                for member, offset, length in records_of(uri):
                    if held and (member != name or offset + length - first > range_bytes or offset < last):
                        rows.append((uri, name, first, last, [x for x, _ in held], [y for _, y in held]))
                        held = []
                    if not held:
                        first, name = offset, member
                    held.append((offset, length))
                    last = offset + length
                if held:
                    rows.append((uri, name, first, last, [x for x, _ in held], [y for _, y in held]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())), strict=True)], names=["path", "member", "first", "last", "offsets", "lengths"])

    ranges = written(paths.where(F.col("path").isNotNull()).select("path").distinct().mapInArrow(plan, "path string, member string, first long, last long, offsets array<long>, lengths array<long>"), "ranges")
    parts = parts or min(max(1, ranges.count()), 4 * int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("package", pa.string()), ("member", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("warc_type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("record_id", pa.string()), ("row_key", pa.string()), ("status", pa.int32()), ("body", pa.string()), ("intact", pa.bool_())])
        uri, f = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != uri:
                    if f is not None:
                        f.close()
                    uri = r["path"]
                    f, _ = open_file(uri)
                data = _read(f, r["first"], r["last"] - r["first"])
                rows = []
                for offset, length in zip(r["offsets"], r["lengths"], strict=True):
                    at = offset - r["first"]
                    rows.append({"package": uri, "member": r["member"], "offset": offset, "length": length, **parse_record(data[at : at + length])})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        if f is not None:
            f.close()

    return ranges.repartition(parts).mapInArrow(fetch, _RECORD)


# Writing.
def record(url: str | None, key: str | None, body: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One gzipped record: a response, or for a null body a metadata record that says so."""
    payload = (body or "").encode("utf-8", "replace")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if body is not None else 'metadata'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: {_digest(payload)}"]
    if url is not None:
        plain = url.isprintable() and url == url.strip()
        lines.append(f"WARC-Target-URI: {url if plain else 'urn:x-other'}")
        if not plain:
            lines.append(f"X-Target-URI-JSON: {json.dumps(url)}")
    if key is not None:
        lines.append(f"X-Row-Key: {key}")
    if body is None:
        lines += ["X-Null-Payload: true", "Content-Type: application/warc-fields"]
        block = b""
    else:
        lines.append("Content-Type: application/http; msgtype=response")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    lines.append(f"Content-Length: {len(block)}")
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def package(records: list[tuple[str | None, bytes]], zip64: bool = False) -> bytes:
    """A package of gzipped records (address, bytes), all members stored."""
    name = "data.warc.gz"
    index, offset = [], 0
    for url, raw in records:
        index.append(f"{json.dumps(url or '')[1:-1].replace(' ', '%20') or '-'} 20240101000000 " + json.dumps({"url": url, "mime": "text/html", "status": "200", "offset": str(offset), "length": str(len(raw)), "filename": name}))
        offset += len(raw)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        with z.open(f"archive/{name}", "w", force_zip64=zip64) as m:
            for _, raw in records:
                m.write(raw)
        z.writestr("indexes/index.cdx", "\n".join(sorted(index)) + "\n")
        z.writestr("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1"}))
    return out.getvalue()


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", package_bytes: int = 64 << 20) -> DataFrame:
    """Writes packages of about ``package_bytes`` into ``folder`` and returns (path, n_records) of those that count: a
    task that is tried again writes new files, and only those of the attempt that succeeded are named."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            fs, base = pafs.FileSystem.from_uri(folder)
            fs.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(package(held))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(held)], pa.int64())], names=["path", "n_records"])

        for batch in batches:
            for u, k, h in zip(batch.column("u").to_pylist(), batch.column("k").to_pylist(), batch.column("h").to_pylist(), strict=True):
                held.append((u, record(u, k, h)))
                size += len(held[-1][1])
                if size >= package_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    picked = pages.select(F.col(f"`{url}`").alias("u"), F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{html}`").alias("h"))
    return picked.mapInArrow(run, "path string, n_records long")


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, html) of every row, packed into packages in the shared folder and read back from there.

    Null keys, addresses and sources come back null, empty ones empty; repeated rows come back as often.
    """
    kind = pages.schema[key].dataType
    folder = f"{shared_dir(pages.sparkSession)}/packages-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + folder
    made = written(write(pages, folder, key, url, html), "package-list")
    return read(made).select(F.col("row_key").cast(kind).alias(key), F.col("url").alias(url), F.col("body").alias(html))
