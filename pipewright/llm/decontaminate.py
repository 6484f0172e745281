"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so that a question with other parameters has the same
template.  Windows of template tokens are hash-joined between benchmark and documents; the slots of a matched
stretch are then checked for consistency.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm._shared import BROADCAST_BYTES, map_arrow, slices, written
from pipewright.llm._text import hashes, mix, text_bytes, tokens, windows

_SLICE = 1 << 20
#: Fewest tokens in a row that add to what other alignments match.
_PIECE = 4
UNITS = tuple(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars euro euros usd eur cent cents "
    "mph kph kmh degree degrees watt watts kw kwh volt volts hz khz mhz ghz kb mb gb tb meter meters metre metres kilometer kilometers kilogram kilograms gram grams pound pounds".split()
)
NUMBER, NAME, UNIT = 1, 2, 3

_CORE = np.zeros(256, dtype=bool)  # a token: letters, digits, non-ASCII
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WITHIN = np.zeros(256, dtype=bool)  # what may stand between the words of one name
_WITHIN[[9, 32, 39, 45]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 58, 59, 63, 10, 13, 34, 40, 124]] = True  # ! . : ; ? line breaks " ( |


def _literal(word: str) -> int:
    b = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(hashes(b, np.array([0]), np.array([len(b)]))[0])


_UNIT_HASHES = np.sort(np.array([_literal(u) for u in UNITS], dtype=np.uint64))


class Templates:
    """Tokens of a slice of texts: ``kind`` 0 is a literal; ``template`` is what windows are made of, ``value`` the
    hash of the token itself (lower-cased).  A number is one token with its separators and decimals.  There are two
    forms of all: with names as placeholders, a run of names being one, and with names as literals, for texts whose
    capitals say nothing (all capitals, titles); ``value`` and ``row`` without a form are the second's."""

    def __init__(self, column: pa.Array):
        data, offsets = text_bytes(column)
        starts, ends, first = tokens(data, offsets, _CORE)
        digits = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(_DIGIT[data], out=digits[1:])
        first_of_row = np.zeros(len(starts) + 1, dtype=bool)
        first_of_row[first] = True
        # '62.5' and '1,210' are one number: digits, one point or comma, digits (after a comma three of them).
        if len(starts) > 1:
            pure = digits[ends] - digits[starts] == ends - starts
            mark = data[np.minimum(ends[:-1], len(data) - 1)]
            joint = pure[:-1] & pure[1:] & (starts[1:] == ends[:-1] + 1) & ((mark == 46) | (mark == 44) & ((ends - starts)[1:] == 3)) & ~first_of_row[1:-1]
            head = np.r_[True, ~joint]
            starts, ends, first = starts[head], ends[np.r_[head[1:], True]], np.r_[0, np.cumsum(head)][first]
        n = len(starts)
        # Lower case: ASCII, and the Latin-1 capitals (C3 80..9E).
        low = _LOWER[data]
        if len(low) > 1:
            latin = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
            low[1:][latin] += 0x20
        value = hashes(low, starts, ends)
        number = digits[ends] > digits[starts]
        head = data[starts] if n else np.zeros(0, np.uint8)
        upper = (head >= 65) & (head <= 90)
        if n:
            after = data[np.minimum(starts + 1, len(data) - 1)]
            upper |= (head == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)
        # A capital opens a sentence if a stop lies between it and the token before, or it opens the row.
        stops = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(_STOP[data], out=stops[1:])
        opens = np.zeros(n, dtype=bool)
        if n:
            opens[1:] = stops[starts[1:]] > stops[ends[:-1]]
            opens[first[:-1][first[:-1] < n]] = True
        unit = np.zeros(n, dtype=bool)
        if n:
            at = np.minimum(np.searchsorted(_UNIT_HASHES, value), len(_UNIT_HASHES) - 1)
            unit[1:] = (_UNIT_HASHES[at] == value)[1:] & number[:-1]
        slots = np.where(number, NUMBER, np.where(unit, UNIT, 0)).astype(np.int8)
        names = np.where((slots == 0) & upper & ~opens, np.int8(NAME), slots)
        # Names that only blanks, hyphens or apostrophes separate are one name.
        joint = np.zeros(n, dtype=bool)
        if n > 1:
            apart = np.zeros(len(data) + 1, dtype=np.int32)
            np.cumsum(~_WITHIN[data], out=apart[1:])
            joint[1:] = (names[1:] == NAME) & (names[:-1] == NAME) & (apart[starts[1:]] == apart[ends[:-1]])
            joint[first[:-1][first[:-1] < n]] = False
        head_of = np.flatnonzero(~joint)
        if len(head_of) < n:
            place = np.arange(n) - head_of[np.cumsum(~joint) - 1]
            run = np.add.reduceat(mix(value + place.astype(np.uint64)), head_of)
            folded = np.where(np.diff(np.r_[head_of, n]) > 1, run, value[head_of])
        else:
            folded = value
        self.kind = [names[head_of], slots]
        self.values = [folded, value]
        self.template = [np.where(k > 0, mix(k.astype(np.uint64)), v) for k, v in zip(self.kind, self.values, strict=True)]
        self.firsts = [np.r_[0, np.cumsum(~joint)][first], first]
        self.rows = [np.repeat(np.arange(len(column)), np.diff(f)) for f in self.firsts]
        self.value, self.first, self.row = value, first, self.rows[1]

    def window(self, n: int, form: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Token positions that start a window of ``n`` tokens of one row, and its hash: of the template, or of the
        tokens as they are."""
        h = windows((self.values if exact else self.template)[form], n)
        if not len(h):
            return np.zeros(0, np.int64), h
        at = np.flatnonzero(self.rows[form][: len(h)] == self.rows[form][n - 1 :])
        return at, h[at]


def consistent(item_kind, item_value, doc_value) -> bool:
    """Whether the slots map one to one: the same value of the item always to the same value of the document, and
    different ones to different ones, within each type."""
    there: dict = {}
    back: dict = {}
    for k, a, b in zip(item_kind, item_value, doc_value, strict=True):
        if k and (there.setdefault((k, a), b) != b or back.setdefault((k, b), a) != a):
            return False
    return True


def runs(item_kind: np.ndarray, item_template: np.ndarray, item_value: np.ndarray, doc_template: np.ndarray, doc_value: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the matched runs with consistent slots of an aligned item and stretch.

    A run whose slots are inconsistent is shortened to its longest consistent beginning or end.
    """
    same = item_template == doc_template
    edges = np.flatnonzero(np.diff(np.r_[False, same, False]))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        start, best = a, b - a
        if not consistent(item_kind[a:b], item_value[a:b], doc_value[a:b]):
            best = 0
            for step in (1, -1):
                there: dict = {}
                back: dict = {}
                n = 0
                for i in range(a, b) if step > 0 else range(b - 1, a - 1, -1):
                    k, x, y = item_kind[i], item_value[i], doc_value[i]
                    if k and (there.setdefault((k, x), y) != y or back.setdefault((k, y), x) != x):
                        break
                    n += 1
                if n > best:
                    start, best = a if step > 0 else b - n, n
        out.append((start, best))
    return out


def compare(item_kind: np.ndarray, item_template: np.ndarray, item_value: np.ndarray, doc_template: np.ndarray, doc_value: np.ndarray) -> tuple[int, int]:
    """(matched tokens, longest run of matched tokens with consistent slots) of an aligned item and stretch."""
    sizes = [n for _, n in runs(item_kind, item_template, item_value, doc_template, doc_value)]
    return sum(sizes), max(sizes, default=0)


def chain(pieces: list[tuple[int, int, int]]) -> int:
    """The most tokens of an item that pieces (place in the item, place in the document, length) match together,
    in the order of both; where two overlap, the tokens count once."""
    p = np.array(sorted(pieces), dtype=np.int64)
    x, y, n = p.T
    total = n.copy()
    for j in range(1, len(p)):
        overlap = np.maximum(np.maximum(x[:j] + n[:j] - x[j], y[:j] + n[:j] - y[j]), 0)
        gain = np.where((y[:j] <= y[j]) & (overlap < n[j]), total[:j] + n[j] - overlap, 0)
        total[j] = max(int(n[j]), int(gain.max()))
    return int(total.max())


class _Items:
    """The benchmark's templates, in memory.  ``by_size``: (size, form, exact) -> window hashes, their items, places
    and whether ``literals`` of ``n`` tokens, in proportion, are literal."""

    def __init__(self, texts: pa.Array, n: int, literals: int):
        t = Templates(texts)
        self.kind, self.template, self.values, self.firsts = t.kind, t.template, t.values, t.firsts
        self.by_size: dict[tuple[int, int, bool], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for form in (0, 1):
            first, row = t.firsts[form], t.rows[form]
            sizes = np.diff(first)
            plain = np.r_[0, np.cumsum(t.kind[form] == 0)]
            for size in sorted({min(n, int(s)) for s in sizes if s}):
                for exact in (False, True):
                    if not exact and size < min(4, n):
                        continue  # so short an item is matched exactly
                    at, h = t.window(size, form, exact)
                    rich = (plain[at + size] - plain[at] >= -(-literals * size // n)) & (not exact)
                    own = (sizes[row[at]] == size) if size < n else np.ones(len(at), dtype=bool)
                    if exact and size >= min(4, n):
                        own = own & (plain[at + size] - plain[at] < -(-literals * size // n))
                    at, h, rich = at[own], h[own], rich[own]
                    order = np.argsort(h, kind="stable")
                    self.by_size[size, form, exact] = (h[order], row[at][order], (at - first[row[at]])[order], (rich | exact)[order])


def _match(items: _Items, t: Templates, coverage: float, min_run: int) -> Iterator[tuple[int, int, int, int, float]]:
    """(row, item, matched, longest run, coverage) of every contaminated row and item."""
    seeds: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    certain: set[tuple[int, int]] = set()
    # Windows that are mostly slots: row, item, form -> diagonals.
    poor: dict[tuple[int, int, int], set[int]] = defaultdict(set)
    for (size, form, exact), (h, item, pos, sure) in items.by_size.items():
        at, hd = t.window(size, form, exact)
        if not len(h) or not len(hd):
            continue
        lo = np.searchsorted(h, hd, side="left")
        hit = np.flatnonzero(h[np.minimum(lo, len(h) - 1)] == hd)
        hi = np.searchsorted(h, hd[hit], side="right")
        for k, a, b in zip(hit.tolist(), lo[hit].tolist(), hi.tolist(), strict=True):
            p = int(at[k])
            row = int(t.rows[form][p])
            for j in range(a, b):
                pair, d = (row, int(item[j])), p - int(pos[j])
                if sure[j]:
                    certain.add(pair)
                    seeds[pair].add((d, form))
                else:
                    poor[*pair, form].add(d)
    more: dict[tuple[int, int], set[tuple[int, int]]] = defaultdict(set)
    for (row, item, form), diagonals in poor.items():
        pair = row, item
        # Without the words that the coverage of literals needs, the row cannot have the item.
        if pair not in certain:
            a, b = items.firsts[form][item : item + 2]
            words = items.values[form][a:b][items.kind[form][a:b] == 0]
            lo, hi = t.firsts[form][row : row + 2]
            if not len(words) or np.isin(words, t.values[form][lo:hi]).sum() < coverage * len(words):
                continue
        more[pair] |= {(d, form) for d in diagonals}
    for pair in more:
        seeds[pair]  # may have no others
    for (row, item), diagonals in seeds.items():
        share, matched, longest, sure = 0.0, 0, 0, (row, item) in certain
        weak = more.get((row, item), set()) - diagonals
        for form in (0, 1):
            a, b = items.firsts[form][item : item + 2].tolist()
            lo, hi = t.firsts[form][row : row + 2].tolist()
            total, run, pieces, seen = 0, 0, [], np.zeros(b - a, dtype=bool)
            literal = items.kind[form][a:b] == 0
            for d in {d for d, f in diagonals | weak if f == form}:
                s, e = max(lo, d), min(hi, d + b - a)
                i = slice(a + s - d, a + e - d)
                found = runs(items.kind[form][i], items.template[form][i], items.values[form][i], t.template[form][s:e], t.values[form][s:e])
                if (d, form) in weak:  # slots alone say nothing
                    found = [(x, k) for x, k in found if literal[s - d + x : s - d + x + k].any()]
                for x, k in found:
                    if k >= _PIECE:
                        pieces.append((s - d + x, s + x, k))
                        seen[s - d + x : s - d + x + k] = True
                    run = max(run, k)
                total = max(total, sum(k for _, k in found))
            # Where no window has enough words, as large a part of the item's words must be there.
            if not sure and (not literal.any() or seen[literal].sum() < coverage * literal.sum()):
                continue
            if pieces and total < b - a:
                total = max(total, chain(pieces))
            longest = max(longest, run)
            if total / (b - a) > share:
                share, matched = total / (b - a), total
        if share >= coverage or longest >= min_run:
            yield row, item, matched, longest, share


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 8, literals: int = 4, coverage: float = 0.5, min_run: int = 25, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """(key, item key, matched_tokens, longest_run, coverage) of each document and benchmark item found in it.

    An item is found where windows of ``n`` template tokens agree (with names as placeholders or as literals) and
    tokens with consistent slots make up ``coverage`` of the item, on one alignment or, in the item's order, on all of
    them together (runs of 4 tokens and more), or ``min_run`` tokens in a row.  If no agreeing window has
    ``literals`` literal tokens or the item's very tokens, ``coverage`` of the item's literal tokens is needed too,
    in runs of 4 and more.  Items of 4 to ``n`` - 1 tokens are one window each; shorter ones are matched exactly.

    Null or empty documents and items match nothing; a repeated document row gives a repeated result, a repeated
    item counts once for each of its rows; empty tables give an empty result; further columns are ignored.

    The benchmark's windows are broadcast if its texts are at most ``limit`` bytes, and looked up in one map over the
    documents.  Those of a larger one are joined by hash with the documents' windows, each text being read twice: once
    for its windows, and once, with the items that share one, to check the slots.
    """
    spark = docs.sparkSession
    bench = benchmark.where(F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").alias("t"))
    size = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count(F.lit(1))).first()
    types = {f.name: f.dataType.simpleString() for f in docs.select(F.col(f"`{key}`").alias("d")).crossJoin(bench.select("i")).schema}
    schema = f"d {types['d']}, i {types['i']}, matched_tokens int, longest_run int, coverage double"
    picked = docs.select(F.col(f"`{key}`").alias("d"), F.col(f"`{text}`").alias("t"))

    def result(piece: pa.RecordBatch, found: list, ids: pa.Array) -> pa.RecordBatch:
        rows, of, matched, longest, share = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays(
            [piece.column("d").take(pa.array(rows)), ids.take(pa.array(of)), pa.array(matched, pa.int32()), pa.array(longest, pa.int32()), pa.array(np.round(share, 6))],
            names=["d", "i", "matched_tokens", "longest_run", "coverage"],
        )

    if int(size[0]) <= limit:
        table = bench.toArrow()
        shared = spark.sparkContext.broadcast((_Items(table.column("t").combine_chunks() if table.num_rows else pa.array([], pa.string()), n, literals), table.column("i").combine_chunks()))

        def run(batch: pa.RecordBatch):
            items, ids = shared.value
            for piece in slices(batch, "t", _SLICE):
                if found := list(_match(items, Templates(piece.column("t")), coverage, min_run)):
                    yield result(piece, found, ids)

        out = map_arrow(picked, run, schema)
    else:
        # Rows of the benchmark are told apart by a number, as their keys may repeat or be null.
        bench = written(bench.withColumn("b", F.monotonically_increasing_id()), "benchmark")
        sizes = sorted(r["n"] for r in map_arrow(bench.select("t"), lambda x: _sizes(x, n), "n int").distinct().collect())

        def item_windows(batch: pa.RecordBatch):
            items = _Items(batch.column("t"), n, literals)
            for (size, form, exact), (h, item, _, _) in items.by_size.items():
                yield pa.RecordBatch.from_arrays([pa.array(_salted(h, size, form, exact).view(np.int64)), batch.column("b").take(pa.array(item))], names=["w", "b"])

        def doc_windows(batch: pa.RecordBatch):
            for piece in slices(batch, "t", _SLICE):
                t = Templates(piece.column("t"))
                for size in sizes:
                    for form in (0, 1):
                        for exact in (False, True):
                            if exact or size >= min(4, n):
                                at, h = t.window(size, form, exact)
                                both = np.unique(np.rec.fromarrays([t.rows[form][at], _salted(h, size, form, exact)], names="row,w"))
                                if len(both):
                                    yield pa.RecordBatch.from_arrays([pa.array(both.w.view(np.int64)), piece.column("d").take(pa.array(both.row))], names=["w", "d"])

        theirs = map_arrow(bench.select("b", "t"), item_windows, "w long, b long").distinct()
        hits = map_arrow(picked.where(F.col("t").isNotNull()), doc_windows, f"w long, d {types['d']}").join(theirs, "w").select("d", "b").distinct()
        hits = written(hits, "window-hits").join(bench.select("b", "i", F.col("t").alias("item")), "b").withColumnRenamed("d", "k")
        pairs = picked.join(hits, picked["d"].eqNullSafe(hits["k"])).select("d", "t", "i", "item")

        def check(batch: pa.RecordBatch):
            for piece in slices(batch, "t", _SLICE):
                for k in range(len(piece)):
                    one = piece.slice(k, 1)
                    if found := list(_match(_Items(one.column("item"), n, literals), Templates(one.column("t")), coverage, min_run)):
                        yield result(one, found, one.column("i"))

        out = map_arrow(pairs, check, schema)
    return out.select(F.col("d").alias(key), F.col("i").alias(item_key), "matched_tokens", "longest_run", "coverage")


def _sizes(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    """The window sizes of the items in a batch."""
    t = Templates(batch.column("t"))
    yield pa.RecordBatch.from_arrays([pa.array(sorted({min(n, int(x)) for f in t.firsts for x in np.diff(f) if x}), pa.int32())], names=["n"])


def _salted(h: np.ndarray, size: int, form: int, exact: bool) -> np.ndarray:
    """Window hashes that agree only where size and form do."""
    return mix(h ^ mix(np.array([size * 4 + form * 2 + exact], dtype=np.uint64)))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, columns unchanged, in which no benchmark item is found.

    A row with a null key cannot be named by the search and stays; rows that share a contaminated key all go.
    """
    found = written(contamination(docs, benchmark, key=key, text=text, **options).select(F.col(key).alias("__bad")).distinct(), "contaminated")
    bad = F.broadcast(found) if found.count() * 16 <= BROADCAST_BYTES else found
    return docs.join(bad, docs[f"`{key}`"] == bad["__bad"], "left_anti")
