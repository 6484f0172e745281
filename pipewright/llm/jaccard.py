"""N-gram Jaccard self-join by chosen paths.

Each text is the set of its word n-grams, embedded in ``SLOTS`` MinHash values.  A node of the recursion samples
slots; a set goes on to the child named by the sampled slot and its value there, so that two sets share a child
with the probability of their similarity.  Small nodes are searched by brute force (on 256-bit sketches); larger
ones split further; whole runs are repeated until a pair at the threshold is found with the target recall at the
depth that the recursion really reached.  Candidates are grouped into components, whose sets are compared exactly,
a large component in tiles that are tasks of their own.  Before that a large component, which mostly hangs together by
pairs below the threshold, is parted where bitmaps of the sets prove that nothing can reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipewright import ship
from pipewright.llm._shared import BROADCAST_BYTES, grouped_arrow, map_arrow, slices, small_or_plain, written
from pipewright.llm._text import WORDS, hashes, mix, text_bytes, tokens, windows
from pipewright.llm.components import components, settled, spanning, tiles

SLOTS = 128
_SLICE = 1 << 20
_U = np.uint64
#: Two sampled slots for each node: two sets of similarity 1/2 then share one child on average.
PICKS = 2
#: Levels after which a node that is still large is searched as it is, in tiles: its sets are nearly all alike.
DEPTH = 4
#: Sets and n-grams in one block of a component that is compared exactly.
_TILE_SETS, _TILE_GRAMS = 1000, 1 << 21
#: Bits of the bitmap of a set, and sets in one block of a component whose bitmaps are compared.
_BITS, _BITMAP_SETS = 1024, 1 << 15


def survival(similarity: float, depth: int) -> float:
    """Probability that one run leads a pair of this similarity into a common node ``depth`` levels down."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** PICKS
    return p


def runs_for(threshold: float, recall: float, depth: int) -> int:
    """Runs after which a pair at the threshold, searched ``depth`` levels down, has met with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth))))


def gram_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Each row's sorted distinct n-gram hashes, of lower-cased words; a text of fewer than n words has one gram, all
    its words; a text without a word has none."""
    data, offsets = text_bytes(column)
    starts, ends, first = tokens(data, offsets, WORDS)
    words = hashes(data, starts, ends)
    grams = windows(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(windows(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


_EDGES = (np.arange(1, SLOTS, dtype=np.uint64) << _U(64 - 7)).astype(np.uint64)


def min_hashes(grams: np.ndarray) -> np.ndarray:
    """One-permutation MinHash with optimal densification: uint16 ``[SLOTS]``."""
    cut = np.searchsorted(grams, _EDGES)
    begin, end = np.r_[0, cut], np.r_[cut, len(grams)]
    filled = begin < end
    values = np.zeros(SLOTS, dtype=np.uint64)
    values[filled] = grams[begin[filled]]
    empty = np.flatnonzero(~filled)
    step = 1
    while len(empty):
        to = (mix((empty.astype(np.uint64) << _U(20)) + _U(step)) >> _U(57)).astype(np.int64)
        ok = filled[to]
        values[empty[ok]] = values[to[ok]]
        empty = empty[~ok]
        step += 1
    return (mix(values) >> _U(48)).astype(np.uint16)


_SALTS = mix(np.arange(1, 257, dtype=np.uint64))


def bit_sketch(slots: np.ndarray) -> np.ndarray:
    """256 one-bit MinHashes, two for each slot: uint64 ``[rows, 4]``."""
    wide = np.concatenate([slots, slots], axis=1).astype(np.uint64)
    bits = (mix(wide * _U(0x9E3779B97F4A7C15) + _SALTS) >> _U(63)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.uint64)


def _sketches(docs: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """(d, h1, h2, grams, slots) of every document with a key and at least one word."""

    def run(batch: pa.RecordBatch):
        for piece in slices(batch, "t", _SLICE):
            keep, one, two, size, slots = [], [], [], [], []
            for k, grams in enumerate(gram_sets(piece.column("t"), n)):
                if len(grams):
                    keep.append(k)
                    one.append(np.bitwise_xor.reduce(mix(grams)))
                    two.append(np.add.reduce(mix(grams ^ _U(0xD1B54A32D192ED03))))
                    size.append(len(grams))
                    slots.append(min_hashes(grams).tobytes())
            yield pa.RecordBatch.from_arrays(
                [piece.column("d").take(pa.array(keep, pa.int64())), pa.array(np.array(one, dtype=np.uint64).view(np.int64)), pa.array(np.array(two, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(slots, pa.binary())],
                names=["d", "h1", "h2", "grams", "slots"],
            )

    picked = docs.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("d"), F.lower(F.col(f"`{text}`")).alias("t"))
    return map_arrow(picked, run, "d long, h1 long, h2 long, grams long, slots binary")


def _slot_array(column: pa.Array) -> np.ndarray:
    data, offsets = column.buffers()[2], column.buffers()[1]
    start = np.frombuffer(offsets, dtype=np.int32)[column.offset]
    return np.frombuffer(data, dtype=np.uint16)[start // 2 : start // 2 + SLOTS * len(column)].reshape(-1, SLOTS)


def _children(path: np.ndarray, slots: np.ndarray) -> list[np.ndarray]:
    """The children of each row's node: PICKS different slots, chosen by the node."""
    out, taken = [], []
    for k in range(PICKS):
        at = mix(path + _U(k + 1)) >> _U(57)
        for other in taken:
            at = np.where(at == other, (at + _U(1)) & _U(SLOTS - 1), at)
        taken.append(at)
        value = slots[np.arange(len(path)), at.astype(np.int64)].astype(np.uint64)
        out.append(mix(path ^ mix((value << _U(8)) + at + _U(1))))
    return out


def _expand(frame: DataFrame) -> DataFrame:
    """(path, set, bits): one row for each child of each row (path, set, slots); rows without a path are at a root."""

    def run(batch: pa.RecordBatch):
        if batch.num_rows:
            slots = _slot_array(batch.column("slots"))
            bits = bit_sketch(slots)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(bits), [None, pa.py_buffer(np.ascontiguousarray(bits))]).cast(pa.binary())
            for child in _children(np.asarray(batch.column("path")).view(np.uint64), slots):
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), batch.column("set"), packed], names=["path", "set", "bits"])

    return map_arrow(frame.select("path", "set", "slots"), run, "path long, set long, bits binary")


def _near(bits: np.ndarray, least_equal: int, block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of one node with at least ``least_equal`` equal bits."""
    m = len(bits)
    step = max(1, block // max(m, 1))
    for a in range(0, m, step):
        differ = np.zeros((min(step, m - a), m), dtype=np.uint16)
        for w in range(4):
            differ += np.bitwise_count(bits[a : a + step, None, w] ^ bits[None, :, w])
        i, j = np.nonzero(differ <= 256 - least_equal)
        ok = i + a < j
        yield i[ok] + a, j[ok]


def _search(rows: DataFrame, parts: int, least_equal: int) -> DataFrame:
    """(a, b): candidate edges between the sets of each node.  No node is large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for table in grouped_arrow(batches, "path"):
            path, sets = table.column("path").to_numpy(), table.column("set").to_numpy()
            packed = table.column("bits").combine_chunks()
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            bits = np.frombuffer(packed.buffers()[2], dtype=np.uint64)[np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset] // 8 :][: 4 * len(path)].reshape(-1, 4)
            first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
            size = np.diff(np.r_[first, len(path)])
            # Nodes of up to 16 sets: all of them at once, by the distance of two rows in the sorted order.
            small = (size > 1) & (size <= 16)
            if small.any():
                at = np.flatnonzero(np.repeat(small, size))
                p, s, b = path[at], sets[at], bits[at]
                for shift in range(1, 16):
                    same = np.flatnonzero(p[shift:] == p[:-shift])
                    if not len(same):
                        break
                    differ = np.bitwise_count(b[same] ^ b[same + shift]).sum(axis=1, dtype=np.int32)
                    hit = same[differ <= 256 - least_equal]
                    if len(hit):
                        yield out(s[hit], s[hit + shift])
            for k in np.flatnonzero(size > 16).tolist():
                own = slice(first[k], first[k] + size[k])
                ii, jj = [], []
                for i, j in _near(bits[own], least_equal):
                    ii.append(i)
                    jj.append(j)
                i, j = np.concatenate(ii), np.concatenate(jj)
                if len(i):
                    a, b = spanning(i, j, int(size[k]))
                    yield out(sets[own][a], sets[own][b])

    ship(rows.sparkSession)
    return rows.repartition(parts, "path").sortWithinPartitions("path").mapInArrow(run, "a long, b long")


def _pair_counts(sets: list[np.ndarray], block: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of the 0/1 matrix of sets and grams."""
    m = len(sets)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    keep = count[column] > 1  # a gram of one set meets no other
    row, column = row[keep], column[keep]
    used, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((m, m), dtype=np.float32)
    width = max(256, min(block, (32 << 20) // (4 * m)))
    for c in range(0, len(used), width):
        a, b = np.searchsorted(column, [c, c + width])
        x = np.zeros((m, width), dtype=np.float32)
        x[row[a:b], column[a:b] - c] = 1.0
        out += x @ x.T
    return out


def _verify(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs of ``sets`` of at least this Jaccard similarity, exactly."""
    size = np.array([len(s) for s in sets], dtype=np.float64)
    if len(sets) == 2:
        both = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]], dtype=np.float64)
    else:
        both = _pair_counts(sets).astype(np.float64)
    return np.nonzero(np.triu(both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9, 1))


def bitmap(grams: np.ndarray) -> np.ndarray:
    """The parities of the numbers of grams that fall on each of ``_BITS`` places: uint64 ``[_BITS / 64]``.  The bitmaps
    of two sets differ in no more places than there are grams in only one of the sets."""
    return np.packbits((np.bincount((grams % _U(_BITS)).astype(np.int64), minlength=_BITS) & 1).astype(np.uint8)).view(np.uint64)


def _merge_near(label: np.ndarray, bits: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float, block: int = 1 << 17) -> np.ndarray:
    """``label`` after merging the labels of all pairs of rows ``x`` with rows ``y`` that may be similar by their sizes and
    bitmaps; both are in order of size.  Equal ``x`` and ``y``: the pairs among them.  No similar pair is left out."""
    # Similar sets differ in at most this share of the sum of their sizes.
    share = (1 - threshold) / (1 + threshold)
    most = (share * size + 0.01).astype(np.float32)
    folded = np.bitwise_xor.reduce(bits.reshape(len(bits), 4, -1), axis=1)
    inner, sizes = x is y, size[y]
    step = max(1, block // max(len(y), 1))
    for a in range(0, len(x), step):
        own = x[a : a + step]
        lo = int(np.searchsorted(sizes, threshold * size[own[0]] - 1e-6))
        hi = int(np.searchsorted(sizes, size[own[-1]] / threshold + 1e-6, side="right"))
        other = y[max(lo, a) if inner else lo : hi]
        differ = np.zeros((len(own), len(other)), dtype=np.uint16)
        for w in range(folded.shape[1]):
            differ += np.bitwise_count(folded[own, w][:, None] ^ folded[other, w][None, :])
        i, j = np.nonzero(differ <= most[own][:, None] + most[other][None, :])
        i, j = own[i], other[j]
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        near = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= most[i] + most[j]
        if near.any():
            root, merged = spanning(label[i[near]], label[j[near]], len(label))
            to = np.arange(len(label))
            to[merged] = root
            label = to[label]
    return label


def _blocks() -> Column:
    """Blocks of a component in the exact comparison: 1 if it is compared at once."""
    n = F.count(F.lit(1))
    return F.greatest(F.ceil(n / F.lit(_TILE_SETS)), F.least(n, F.ceil(F.sum("grams") / F.lit(_TILE_GRAMS))))


class _Join:
    """The steps that the join and the deduplication share."""

    def __init__(self, docs: DataFrame, n: int, threshold: float, recall: float, node_limit: int, key: str, text: str):
        self.docs, self.n, self.threshold, self.key, self.text, self.node_limit = docs, n, threshold, key, text, node_limit
        self.parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = written(_sketches(docs, n, key, text), "sketches")
        # Equal sets are one node of the join: any two of them have similarity 1.  Nothing of a set's documents is
        # gathered but the smallest and the largest key.
        self.sets = written(self.rows.groupBy("h1", "h2").agg(F.min("d").alias("rep"), F.max("d").alias("last"), F.first("grams").alias("grams"), F.first("slots").alias("slots")), "sets")
        # A pair at the threshold has three standard deviations of the sketch to be recognised.
        self.least_equal = math.floor(256 * (1 + threshold) / 2 - 3 * 256 * math.sqrt((1 - threshold * threshold) / 4 / 256 * 1.5))
        # Half of the pairs that may be missed are left to the sketches.
        target = 1 - (1 - recall) / 2
        runs = runs_for(threshold, target, 1)
        edges, depth, large = self._runs(self.sets, 0, runs)
        if large is not None:
            # Only sets that were in a large node have pairs that are found further down.
            more = runs_for(threshold, target, depth) - runs
            if more > 0:
                edges = edges.unionAll(self._runs(self.sets.join(large, self.sets["h1"] == large["set"], "left_semi"), runs, more)[0])
        self.groups = self._parted(written(components(edges), "groups"))

    def _runs(self, sets: DataFrame, first: int, runs: int) -> tuple[DataFrame, int, DataFrame | None]:
        """Candidate edges of so many runs, the depth reached, and the sets that were in large nodes, if any."""
        roots = F.explode(F.array(*[F.lit(int(mix(np.array([r + 1], dtype=np.uint64)).view(np.int64)[0])) for r in range(first, first + runs)]))
        frame = sets.select(roots.alias("path"), F.col("h1").alias("set"), "slots")
        edges = large = None
        for depth in range(1, DEPTH + 1):
            rows = written(_expand(frame), "paths")
            # Large nodes are known by counts before anything is shuffled by node: their rows go on as they are.
            hot = written(rows.groupBy("path").count().where(F.col("count") > self.node_limit), "large-nodes")
            n_hot = hot.count()
            more = None
            if n_hot:
                hot = F.broadcast(hot) if n_hot * 16 <= BROADCAST_BYTES else hot
                more = rows.join(hot, "path")
                rows = rows.join(hot, "path", "left_anti")
            own = _search(rows, self.parts, self.least_equal)
            if n_hot and depth == DEPTH:
                # Pairs of blocks of a large node: as many tasks as it needs.
                pairs = tiles(more.withColumn("blocks", F.ceil(F.col("count") / F.lit(self.node_limit))), "path", "set", "blocks")
                own = own.unionAll(_search(pairs.select(F.col("tile").alias("path"), "set", "bits"), self.parts, self.least_equal))
            own = written(own, "candidates")
            edges = own if edges is None else edges.unionAll(own)
            if not n_hot or depth == DEPTH:
                return edges, depth, large
            more = written(more.select("path", "set"), "more")
            if large is None:
                large = written(more.select("set").distinct(), "large-sets")
            frame = more.join(self.sets.select(F.col("h1").alias("set"), "slots"), "set")

    def _named(self, groups: DataFrame) -> DataFrame:
        return self.sets.join(groups, self.sets["h1"] == groups["node"]).select("rep", "h1", "grams", "component")

    def _texts(self) -> DataFrame:
        return self.docs.select(F.col(f"`{self.key}`").cast("long").alias("rep"), F.col(f"`{self.text}`").alias("t")).where(F.col("t").isNotNull())

    def _parted(self, groups: DataFrame) -> DataFrame:
        """``groups`` with each component of several blocks replaced by those of its pairs that may be similar by their
        bitmaps: all of its pairs at the threshold are in these, and sets without any are in none."""
        n, threshold = self.n, self.threshold
        named = self._named(groups)
        large = named.groupBy("component").agg(_blocks().alias("blocks"), F.count(F.lit(1)).alias("n")).where("blocks > 1")
        large = written(large.select("component", F.ceil(F.col("n") / F.lit(_BITMAP_SETS)).alias("blocks")), "large-components")
        if large.isEmpty():
            return groups
        large = small_or_plain(large, 16)
        member = small_or_plain(written(named.join(large, "component").select("rep", "h1", "component", "blocks"), "large-members"), 40)
        texts = self._texts().join(member, "rep").select("h1", "component", "blocks", F.lower("t").alias("t"))

        def draw(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for piece in slices(batch, "t", _SLICE):
                h1, keep, size, bits = piece.column("h1").to_numpy(), [], [], []
                for k, grams in enumerate(gram_sets(piece.column("t"), n)):
                    # The text must be the one that was sketched: keys can repeat.
                    if len(grams) and np.bitwise_xor.reduce(mix(grams)).view(np.int64) == h1[k]:
                        keep.append(k)
                        size.append(len(grams))
                        bits.append(bitmap(grams).tobytes())
                at = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([*[piece.column(c).take(at) for c in ("component", "blocks", "h1")], pa.array(size, pa.int64()), pa.array(bits, pa.binary())], names=["component", "blocks", "set", "size", "bits"])

        drawn = written(map_arrow(texts, draw, "component long, blocks long, set long, size long, bits binary").dropDuplicates(["set"]), "bitmaps")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in grouped_arrow(batches, "tile"):
                tile, sets, side, own = (table.column(c).to_numpy() for c in ("tile", "set", "side", "own"))
                size = table.column("size").to_numpy().astype(np.float64)
                bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint64).reshape(len(sets), -1)
                first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
                for lo, hi in zip(first.tolist(), np.r_[first[1:], len(tile)].tolist(), strict=True):
                    order = lo + np.argsort(size[lo:hi], kind="stable")
                    s, b, z, label = sets[order], bits[order], size[order], np.arange(hi - lo)
                    sides = [np.flatnonzero(side[order] == x) for x in (True, False)]
                    for x in sides:
                        if len(x) and own[order[x[0]]]:
                            label = _merge_near(label, b, z, x, x, threshold)
                    if len(sides[0]) and len(sides[1]):
                        label = _merge_near(label, b, z, sides[0], sides[1], threshold)
                    merged = np.flatnonzero(label != np.arange(len(label)))
                    yield pa.RecordBatch.from_arrays([pa.array(s[label[merged]]), pa.array(s[merged])], names=["a", "b"])

        paired = tiles(drawn, "component", "set", "blocks").select("tile", "set", "side", "own", "size", "bits")
        edges = paired.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")
        rest = groups.join(large, "component", "left_anti").select("node", "component")
        return written(rest.unionAll(components(edges)), "parts")

    def verified(self) -> DataFrame:
        """(a, b, links, whole): of each set that is similar to another one a row (set, itself, number of such sets),
        to be summed up, and edges (set, set, 0) that connect what is similar; ``whole``: the edge leads to the name
        of its group."""
        n, threshold = self.n, self.threshold
        named = self._named(self.groups)
        sizes = named.groupBy("component").agg(_blocks().alias("blocks"))
        member = tiles(named.join(sizes, "component"), "component", "h1", "blocks").select("rep", "h1", "tile", "side", "own", (F.col("blocks") <= 1).alias("whole"))
        member = small_or_plain(written(member, "members"), 40)
        texts = self._texts().join(member, "rep").select("tile", "h1", "side", "own", "whole", F.lower("t").alias("t"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in grouped_arrow(batches, "tile", 256):
                name, h1, side, own, whole = (table.column(c).to_numpy() for c in ("tile", "h1", "side", "own", "whole"))
                sets: list[np.ndarray] = []
                for batch in table.select(["t"]).to_batches():
                    for piece in slices(batch, "t", _SLICE):
                        sets += gram_sets(piece.column("t"), n)
                first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
                for lo, hi in zip(first.tolist(), np.r_[first[1:], len(name)].tolist(), strict=True):
                    # The text must be the one that was sketched, once for each set: keys can repeat.
                    there = {}
                    for k in range(lo, hi):
                        if len(sets[k]) and np.bitwise_xor.reduce(mix(sets[k])).view(np.int64) == h1[k]:
                            there.setdefault(int(h1[k]), k)
                    if len(there) < 2:
                        continue
                    index = np.array([there[x] for x in sorted(there)])
                    i, j = _verify([sets[k] for k in index], threshold)
                    ok = (side[index[i]] != side[index[j]]) | own[index[i]]
                    i, j = i[ok], j[ok]
                    if not len(i):
                        continue
                    links = np.bincount(i, minlength=len(index)) + np.bincount(j, minlength=len(index))
                    some = np.flatnonzero(links)
                    a, b = spanning(i, j, len(index))
                    aa, bb = np.r_[some, a], np.r_[some, b]
                    yield pa.RecordBatch.from_arrays([pa.array(h1[index[aa]]), pa.array(h1[index[bb]]), pa.array(np.r_[links[some], np.zeros(len(a), np.int64)]), pa.array(np.full(len(aa), bool(whole[lo])))], names=["a", "b", "links", "whole"])

        return texts.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long, links long, whole boolean")

    def classes(self) -> DataFrame:
        """(h1, text_id, class_id, n_links) of each set with more than one document or with a similar set."""
        stars = settled(self.verified())
        of = self.sets.select("h1", "rep", "last").join(stars, F.col("h1") == F.col("node"), "left").where("node is not null or rep <> last")
        of = written(of.select("h1", F.col("rep").alias("text_id"), F.coalesce("component", "h1").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "linked")
        return of.join(of.groupBy("c").agg(F.min("text_id").alias("class_id")), "c").select("h1", "text_id", "class_id", "n_links")

    def members(self) -> DataFrame:
        """(d, text_id, class_id, n_links) of the documents of those sets."""
        classes = small_or_plain(written(self.classes(), "classes"), 48)
        return self.rows.select("h1", "d").join(classes, "h1").drop("h1").distinct()


def similar(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.98, node_limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, text_id, n_links): one row for each document that has a similar one.

    ``text_id`` is the smallest document with the same n-gram set, ``n_links`` the number of other n-gram sets (of
    different texts) whose similarity is at least ``threshold``, and ``class_id`` the smallest document that can be
    reached over such links and equal sets.  Similarities are exact; links at the threshold are found with probability
    ``recall``, closer ones with more; equal sets always.

    Null keys, null and wordless texts match nothing; repeated rows count as one document; a key with several different
    texts has a row for each that has a similar one; an empty table gives an empty result; other columns are ignored.
    ``key`` must be an integer.

    Nodes of more than ``node_limit`` sets split; what is still larger after ``DEPTH`` levels is searched in tiles of
    that size, and so is any large component in the exact comparison: no node, component or set is one task's alone.
    """
    join = _Join(docs, n, threshold, recall, node_limit, key, text)
    return join.members().select(F.col("d").alias(key), "class_id", "text_id", "n_links")


def deduplicate(docs: DataFrame, n: int = 3, threshold: float = 0.5, recall: float = 0.98, node_limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, columns unchanged, with one document of each class of :func:`similar`: that with the smallest
    key.

    Rows with a null key or a null or wordless text are in no class and stay; of repeated rows one stays; if rows
    share a key but not a text, all of that key go when one of them must.
    """
    join = _Join(docs, n, threshold, recall, node_limit, key, text)
    gone = written(join.members().where("d <> class_id").select(F.col("d").alias("__gone")).distinct(), "near-duplicates")
    gone = small_or_plain(gone, 16)
    kept = docs.join(gone, docs[f"`{key}`"].cast("long") == gone["__gone"], "left_anti")
    # Rows that repeat one key and one set: few keys, so only their rows are shuffled.
    twice = written(join.rows.groupBy("h1", "d").count().where("count > 1").select(F.col("d").alias("__twice")).distinct(), "repeated")
    if twice.isEmpty():
        return kept
    twice = small_or_plain(twice, 16)
    same = docs[f"`{key}`"].cast("long") == twice["__twice"]
    once = kept.join(twice, same, "left_semi").dropDuplicates([key, text])
    return kept.join(twice, same, "left_anti").unionAll(once)
