"""Long passages repeated across documents, with a logarithmic family of suffix arrays.

A suffix is what follows a word; an array holds suffixes in the order of their words, with the length of the prefix
that each shares with the one before (LCP).  Suffixes that agree in their first ``length`` words are one entry with all
their places.  New suffixes come in batches: a batch gets its own array and is merge-scanned against every level of the
family for entries that both have, that is for matches of ``length`` words and more; equal-sized levels then merge, so
that n suffixes are in log n levels and each takes part in log n merges.

The family is sharded: a suffix goes to the shard of its anchor, the least n-gram hash among the n-grams in its first
``length`` words (equal passages contain the same ones, so they meet in one shard).  Words travel as 32-bit codes, in
segments: the words that neighbouring suffixes with one anchor need.  :class:`SuffixIndex` keeps its family in a folder,
to which further batches are added.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipewright import ship
from pipewright.llm._shared import map_arrow, slices, small_or_plain, written
from pipewright.llm._text import SPACES, hashes, mix, text_bytes, tokens, windows

_SLICE = 1 << 20
_U = np.uint64
SPACES_NOT = ~SPACES
#: Suffixes in one batch of a family, about so many in one shard, and in one task, which takes its shards one by one.
BATCH, SHARD, TASK = 1 << 18, 1 << 19, 1 << 24
#: Word codes in one Arrow batch.
_CODES = 1 << 22
#: Suffixes of one anchor above which they are not sorted in one shard but counted window by window.
HOT = 1 << 21


def suffix_order(codes: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of ``codes`` that start ``at``, by their first ``length`` words, and in that order the
    number of words that each shares with the one before it.

    Two words are compared at a time, and after the first two only those that are still tied.  The first sort is
    numpy's merge sort of runs, so suffixes that come as two sorted sequences are merged in linear time.
    """

    def pair(which: np.ndarray, k: int) -> np.ndarray:
        key = codes[at[which] + k].astype(np.uint64) << _U(32)
        return key | codes[at[which] + k + 1] if k + 1 < length else key

    key = pair(np.arange(len(at)), 0)
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    shared = np.zeros(len(at), dtype=np.int32)
    shared[1:] = np.where(same, min(2, length), (key[1:] >> _U(32)) == (key[:-1] >> _U(32)))
    k = 2
    while k < length:
        tied = np.r_[False, same]
        place = np.flatnonzero(tied | np.r_[same, False])
        if not len(place):
            break
        joined = tied[place]
        group = np.cumsum(~joined)
        own = order[place]
        key = pair(own, k)
        by = np.lexsort((key, group))
        order[place], key = own[by], key[by]
        within = np.flatnonzero(joined)
        equal = key[within] == key[within - 1]
        shared[place[within]] = np.where(equal, min(k + 2, length), k + ((key[within] >> _U(32)) == (key[within - 1] >> _U(32))))
        same[place[within] - 1] = equal
        k += 2
    return order, shared


class Level:
    """One suffix array over ``codes``.  Entries, in the order of their words: ``at`` (where the first ``length`` words
    stand), ``key`` (their hash), ``lcp``, ``low`` and ``high`` (least and largest document known to have them); ``by``:
    the entries in the order of ``key``.  Places: ``entry``, ``doc``, ``pos``."""

    __slots__ = ("at", "by", "codes", "doc", "entry", "high", "key", "lcp", "low", "pos")

    def __len__(self) -> int:
        return len(self.entry)


def suffix_array(codes: np.ndarray, ends: np.ndarray, docs: np.ndarray, firsts: np.ndarray, length: int) -> Level:
    """The array of a batch of segments: segment i is ``codes[ends[i - 1]:ends[i]]``, of document ``docs[i]``, where it
    starts at word ``firsts[i]``."""
    starts = np.r_[0, ends[:-1]]
    n = ends - starts - length + 1
    at = np.repeat(starts - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    level = Level()
    level.codes = codes
    key = windows(mix(codes.astype(np.uint64)), length)[at]
    level.key, one, which = np.unique(key, return_index=True, return_inverse=True)
    level.doc = np.repeat(docs, n)
    level.pos = (at - np.repeat(starts - firsts, n)).astype(np.int32)
    by = np.argsort(which, kind="stable")
    head = np.flatnonzero(np.r_[True, which[by][1:] != which[by][:-1]]) if len(by) else by
    level.low = np.minimum.reduceat(level.doc[by], head) if len(by) else level.doc
    level.high = np.maximum.reduceat(level.doc[by], head) if len(by) else level.doc
    level.at = at[one]
    return _sorted(level, which, length, np.arange(len(one)))


def _sorted(level: Level, which: np.ndarray, length: int, by: np.ndarray | None = None) -> Level:
    order, level.lcp = suffix_order(level.codes, level.at, length)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    level.entry = rank[which]
    for name in ("at", "key", "low", "high"):
        setattr(level, name, getattr(level, name)[order])
    level.by = np.argsort(level.key).astype(np.int32) if by is None else rank[by]
    return level


def _common(a: Level, b: Level) -> tuple[np.ndarray, np.ndarray]:
    """Entries of two arrays with the same first words."""
    if not len(a.key) or not len(b.key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Both in the order of their hashes: neighbouring searches then meet the same part of the array.
    x, y = a.key[a.by], b.key[b.by]
    there = np.minimum(np.searchsorted(y, x), len(y) - 1)
    hit = np.flatnonzero(y[there] == x)
    return a.by[hit], b.by[there[hit]]


def merge_scan(a: Level, b: Level) -> None:
    """Exchanges what two arrays know of the passages that both have."""
    i, j = _common(a, b)
    low, high = np.minimum(a.low[i], b.low[j]), np.maximum(a.high[i], b.high[j])
    a.low[i], a.high[i], b.low[j], b.high[j] = low, high, low, high


def merged(a: Level, b: Level, length: int) -> Level:
    """The two arrays as one."""
    i, j = _common(a, b)
    new = np.ones(len(b.key), dtype=bool)
    new[j] = False
    to = np.empty(len(b.key), dtype=np.int64)
    to[j] = i
    to[new] = len(a.key) + np.arange(new.sum())
    out = Level()
    out.codes = np.concatenate([a.codes, b.codes])
    out.at = np.concatenate([a.at, b.at[new] + len(a.codes)])
    for name in ("key", "low", "high"):
        setattr(out, name, np.concatenate([getattr(a, name), getattr(b, name)[new]]))
    out.low[i], out.high[i] = np.minimum(a.low[i], b.low[j]), np.maximum(a.high[i], b.high[j])
    out.doc, out.pos = np.concatenate([a.doc, b.doc]), np.concatenate([a.pos, b.pos])
    return _sorted(out, np.concatenate([a.entry, to[b.entry]]), length)


class Family:
    """Levels of geometrically growing sizes."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[Level] = []

    def add(self, codes: np.ndarray, ends: np.ndarray, docs: np.ndarray, firsts: np.ndarray) -> Level:
        """Adds a batch of segments; its array, with what the levels know of it."""
        batch = suffix_array(codes, ends, docs, firsts, self.length)
        for level in self.levels:
            merge_scan(batch, level)
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merged(a, b, self.length))
        return batch

    def whole(self) -> Level | None:
        """All levels as one array."""
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(merged(a, b, self.length))
        return self.levels[0] if self.levels else None


def _found(level: Level | None, length: int) -> Iterator[pa.RecordBatch]:
    """(d, first, s, e): stretches of a level's suffixes that another document has too."""
    if level is None or not len(level):
        return
    hit = np.flatnonzero((level.low != level.high)[level.entry])
    doc, pos, first = level.doc[hit], level.pos[hit], level.doc[hit] == level.low[level.entry[hit]]
    order = np.lexsort((pos, first, doc))
    doc, pos, first = doc[order], pos[order], first[order]
    if len(doc):
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (pos[1:] > pos[:-1] + 1)])
        last = np.r_[new[1:], len(doc)] - 1
        yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(first[new]), pa.array(pos[new]), pa.array((pos[last] + length).astype(np.int32))], names=["d", "first", "s", "e"])


_FOUND = "d long, first boolean, s int, e int"


def _least(h: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` values, the index of its first least value, by doubling."""
    n = len(h)
    value, at, width = h, np.arange(n), 1
    while width * 2 <= span:
        take = value[width:] < value[:-width]
        value, at = np.where(take, value[width:], value[:-width]), np.where(take, at[width:], at[:-width])
        width *= 2
    if width < span:
        shift = span - width
        take = value[shift:] < value[:-shift]
        at = np.where(take, at[shift:], at[:-shift])
    return at



def segments(docs: DataFrame, length: int, gram: int, key: str, text: str, only_sizes: bool = False) -> DataFrame:
    """(anchor, d, start, codes): for each anchor of a document the words, as 32-bit codes, of the neighbouring suffixes
    anchored there (the words of the last one's first ``length`` included), from word ``start``.  With ``only_sizes``
    (anchor, n): the number of those suffixes."""
    span = length - gram + 1

    def run(batch: pa.RecordBatch):
        for piece in slices(batch, "t", _SLICE):
            data, offsets = text_bytes(piece.column("t"))
            starts, ends, first = tokens(data, offsets, SPACES_NOT)
            words = hashes(data, starts, ends)
            if len(words) < length:
                continue
            small = windows(words, gram)
            at = _least(small, span)
            row = np.repeat(np.arange(len(piece)), np.diff(first))
            ok = np.flatnonzero(row[: len(at)] == row[length - 1 :])
            if not len(ok):
                continue
            group = np.flatnonzero(np.r_[True, (at[ok][1:] != at[ok][:-1]) | (ok[1:] != ok[:-1] + 1) | (row[ok][1:] != row[ok][:-1])])
            lead = ok[group]
            n = np.diff(np.r_[group, len(ok)])
            anchors = pa.array(small[at[lead]].view(np.int64))
            if only_sizes:
                yield pa.RecordBatch.from_arrays([anchors, pa.array(n)], names=["anchor", "n"])
                continue
            size = n + length - 1
            ends_at = np.cumsum(size)
            low = (words >> _U(32)).astype(np.uint32)
            places, begins = piece.column("d").take(pa.array(row[lead])), pa.array((lead - first[row[lead]]).astype(np.int32))
            # One batch for each so many codes: the segments of a very long text do not fit into one.
            cuts = np.unique(np.r_[0, np.searchsorted(ends_at, np.arange(_CODES, ends_at[-1], _CODES), side="right"), len(lead)])
            for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                bounds = np.r_[0, ends_at[p:q]] - (ends_at[p - 1] if p else 0)
                bounds[0] = 0
                codes = low[np.repeat(lead[p:q] - bounds[:-1], size[p:q]) + np.arange(bounds[-1])]
                lists = pa.BinaryArray.from_buffers(pa.binary(), q - p, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(codes)])
                yield pa.RecordBatch.from_arrays([anchors.slice(p, q - p), places.slice(p, q - p), begins.slice(p, q - p), lists], names=["anchor", "d", "start", "codes"])

    picked = docs.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("d"), F.col(f"`{text}`").alias("t"))
    return map_arrow(picked, run, "anchor long, n long" if only_sizes else "anchor long, d long, start int, codes binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, ends, documents and starts of a batch of segments."""
    column = batch.column("codes")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    codes = np.frombuffer(column.buffers()[2], dtype=np.uint32)[bounds[0] : bounds[-1]] if bounds[-1] else np.zeros(0, np.uint32)
    return codes, bounds[1:] - bounds[0], np.asarray(batch.column("d")), np.asarray(batch.column("start"))


class _Batches:
    """Gathers segments to batches of about ``BATCH`` suffixes and adds them to a family."""

    def __init__(self, family: Family):
        self.family, self.held, self.count, self.added = family, [], 0, []

    def take(self, codes, ends, docs, starts) -> None:
        self.held.append((codes, ends, docs, starts))
        self.count += len(codes) - len(ends) * (self.family.length - 1)
        if self.count >= BATCH:
            self.flush()

    def flush(self) -> None:
        if self.held:
            shift = np.r_[0, np.cumsum([len(c) for c, *_ in self.held])]
            ends = np.concatenate([e + s for (_, e, _, _), s in zip(self.held, shift, strict=False)])
            codes, docs, starts = (np.concatenate([h[k] for h in self.held]) for k in (0, 2, 3))
            self.added.append(self.family.add(codes, ends, docs, starts))
        self.held, self.count = [], 0


def _passages(found: DataFrame, key: str) -> DataFrame:
    """(key, start_word, end_word, n_words, first): the maximal stretches of what was found."""
    w = Window.partitionBy("d", "first").orderBy("s", "e")
    marked = found.withColumn("new", (F.col("s") > F.coalesce(F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    marked = marked.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = marked.groupBy("d", "first", "island").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"))
    return rows.select(F.col("d").alias(key), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first")


def _counted(parts: DataFrame, length: int) -> DataFrame:
    """(d, first, s, e) of segments whose anchor is hot: windows are counted by hash with partial sums on the map side,
    so that no task sees all of an anchor's."""

    def run(batch: pa.RecordBatch):
        codes, ends, docs, starts = _unpacked(batch)
        begin = np.r_[0, ends[:-1]]
        n = ends - begin - length + 1
        at = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        key = windows(mix(codes.astype(np.uint64)), length)[at] if len(at) else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(docs, n)), pa.array((at - np.repeat(begin - starts, n)).astype(np.int32))], names=["w", "d", "s"])

    rows = written(map_arrow(parts, run, "w long, d long, s int"), "hot-windows")
    twice = written(rows.groupBy("w").agg(F.min("d").alias("low"), F.max("d").alias("high")).where("low <> high").select("w", "low"), "hot-repeats")
    return rows.join(small_or_plain(twice, 24), "w").select("d", (F.col("d") == F.col("low")).alias("first"), "s", (F.col("s") + length).alias("e")).distinct()


def repeats(docs: DataFrame, length: int = 50, gram: int = 10, key: str = "doc_id", text: str = "text", shards: int | None = None, hot: int = HOT) -> DataFrame:
    """(key, start_word, end_word, n_words, first) of the passages of at least ``length`` words that occur in more
    than one document.

    Words are separated by white space and compared as they are.  A window of ``length`` words is repeated if it
    occurs in another document; each maximal run of words that repeated windows cover is one row.  ``first`` splits
    the windows: it is true of those whose document has the smallest key of all that have them, so that rows with
    ``first = false`` are what deduplication removes.  All windows of all documents are compared.

    Documents with a null key, null or shorter texts have no passages; repeated rows and rows that share a key
    are one document, which does not repeat itself; an empty table gives an empty result; other columns are
    ignored.  ``key`` must be an integer.

    A first pass counts suffixes by anchor: it sets the numbers of tasks and of shards (``SHARD`` suffixes each; a task
    sorts its segments by shard and holds one shard at a time), and anchors with more
    than ``hot`` of them, which a passage in very many documents has, are counted window by window instead of sorted
    in one shard.
    """
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    spark = docs.sparkSession
    ship(spark)
    sizes = segments(docs, length, gram, key, text, only_sizes=True).groupBy("anchor").agg(F.sum("n").alias("n"))
    total, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK))
    shards = max(1, -(-(shards or -(-total // SHARD)) // tasks))  # of each task
    parts = segments(docs, length, gram, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, gathered = None, _Batches(Family(length))
        for batch in batches:
            names = np.asarray(batch.column("shard"))
            first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else []
            for a, b in zip(first, [*first[1:], len(names)], strict=True):
                if names[a] != shard:
                    gathered.flush()
                    yield from _found(gathered.family.whole(), length)
                    shard, gathered = names[a], _Batches(Family(length))
                gathered.take(*_unpacked(batch.slice(a, b - a)))
        gathered.flush()
        yield from _found(gathered.family.whole(), length)

    found = None
    if most > hot:
        names = small_or_plain(written(sizes.where(F.col("n") > hot).select("anchor"), "hot-anchors"), 16)
        found = _counted(parts.join(names, "anchor", "left_semi").select("d", "start", "codes"), length)
        parts = parts.join(names, "anchor", "left_anti")
    dealt = parts.repartition(tasks, "anchor").select(F.pmod(F.xxhash64(F.lit("shard"), "anchor"), F.lit(shards)).alias("shard"), "d", "start", "codes")
    sorted_ = (dealt.sortWithinPartitions("shard") if shards > 1 else dealt).mapInArrow(run, _FOUND)
    return _passages(sorted_ if found is None else sorted_.unionAll(found), key)


class SuffixIndex:
    """A family of suffix arrays in a folder that all executors share (made with the first batch).

    Each shard has its own levels: files of numpy arrays, named by the shard's manifest of the last committed
    generation.  A batch reads them, is scanned against each, merges equal sizes and writes a new manifest; levels
    that do not merge are not written again.  A task that is tried again writes files of other names, and a job that
    fails leaves the last generation as it was.  The number of shards is fixed at the beginning.
    """

    def __init__(self, spark: SparkSession, folder: str, length: int = 50, gram: int = 10, shards: int = 256):
        if not 1 <= gram <= length:
            raise ValueError("gram must be between 1 and length")
        ship(spark)
        self.spark, self.folder = spark, folder.rstrip("/")
        known = _load(f"{self.folder}/current.json")
        self.state = json.loads(known) if known else {"generation": 0, "length": length, "gram": gram, "shards": shards}

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """Adds documents that are not in the index yet.  Gives their passages that older documents or other new ones
        have too, as :func:`repeats` does; ``first`` holds where no document with a smaller key is known to have it."""
        length, gram, shards = (self.state[k] for k in ("length", "gram", "shards"))
        folder, old = self.folder, self.state["generation"]
        parts = segments(docs, length, gram, key, text).select(F.pmod("anchor", F.lit(shards)).alias("shard"), "d", "start", "codes")
        # Every shard is visited: its manifest goes on even if the batch has nothing for it.
        parts = parts.unionAll(self.spark.range(shards).select(F.col("id").alias("shard"), F.lit(None).cast("long"), F.lit(0), F.lit(b"")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, gathered = None, None

            def close() -> Iterator[pa.RecordBatch]:
                gathered.flush()
                for level in gathered.added:
                    yield from _found(level, length)
                _store_family(folder, old + 1, shard, gathered.family)

            for batch in batches:
                names = np.asarray(batch.column("shard"))
                first = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else []
                for a, b in zip(first, [*first[1:], len(names)], strict=True):
                    if names[a] != shard:
                        if shard is not None:
                            yield from close()
                        shard = int(names[a])
                        gathered = _Batches(_load_family(folder, old, shard, length))
                    own = batch.slice(a, b - a)
                    own = own.filter(own.column("d").is_valid())
                    if own.num_rows:
                        gathered.take(*_unpacked(own))
            if shard is not None:
                yield from close()

        n = min(shards, max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))))
        found = f"{folder}/found-{uuid.uuid4().hex}"
        parts.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(run, _FOUND).write.parquet(found)
        self.state = self.state | {"generation": old + 1}
        _store(f"{folder}/current.json", json.dumps(self.state).encode())
        return _passages(self.spark.read.schema(_FOUND).parquet(found), key)

    def repeats(self, key: str = "doc_id") -> DataFrame:
        """The passages of all documents of the index, as :func:`repeats` gives them."""
        folder, at, length = self.folder, self.state["generation"], self.state["length"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column("id").to_pylist():
                    yield from _found(_load_family(folder, at, shard, length).whole(), length)

        n = self.state["shards"] if at else 0
        return _passages(self.spark.range(0, n, 1, max(n, 1)).mapInArrow(run, _FOUND), key)


def _store(path: str, data: bytes) -> None:
    """Writes a file under another name and moves it into place."""
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    made = f"{at}.{uuid.uuid4().hex}"
    with fs.open_output_stream(made) as out:
        out.write(data)
    fs.move(made, at)


def _load(path: str) -> bytes | None:
    fs, at = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(at).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(at) as f:
        return f.read()


def _store_family(folder: str, generation: int, shard: int, family: Family) -> None:
    names = []
    for level in family.levels:
        name = family.names.get(id(level)) if hasattr(family, "names") else None
        if name is None:
            name = f"{uuid.uuid4().hex}.npz"
            out = io.BytesIO()
            np.savez(out, **{k: getattr(level, k) for k in Level.__slots__})
            _store(f"{folder}/levels/{name}", out.getvalue())
        names.append(name)
    _store(f"{folder}/generation-{generation}/{shard}.json", json.dumps(names).encode())


def _load_family(folder: str, generation: int, shard: int, length: int) -> Family:
    """The shard's levels; what they know of one another is exchanged anew when they meet."""
    family = Family(length)
    family.names = {}
    manifest = _load(f"{folder}/generation-{generation}/{shard}.json") if generation else None
    for name in json.loads(manifest) if manifest else ():
        with np.load(io.BytesIO(_load(f"{folder}/levels/{name}"))) as arrays:
            level = Level()
            for k in Level.__slots__:
                setattr(level, k, arrays[k])
        family.levels.append(level)
        family.names[id(level)] = name
    return family
