"""Vectorised tokenising and hashing of UTF-8 text, straight on Arrow buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_BI = np.uint64(pow(int(_B), -1, 1 << 64))

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
WORDS = np.zeros(256, dtype=bool)
WORDS[48:58] = WORDS[65:91] = WORDS[97:123] = WORDS[128:] = True

_powers = {True: np.ones(1, np.uint64), False: np.ones(1, np.uint64)}


def _power(inverse: bool, n: int) -> np.ndarray:
    if len(_powers[inverse]) < n:
        p = np.full(n + n // 4, _BI if inverse else _B, dtype=np.uint64)
        p[0] = 1
        _powers[inverse] = np.multiply.accumulate(p)
    return _powers[inverse][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; nulls are empty."""
    kind = pa.large_string() if pa.types.is_large_string(column.type) else pa.string()
    if column.type != kind:
        column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = np.int64 if kind == pa.large_string() else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=wide, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    if buffers[2] is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def tokens(data: np.ndarray, offsets: np.ndarray, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of ``alphabet`` bytes within a row, and the first token of each row
    (``len(offsets)`` values, the last is the number of tokens)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = alphabet[data]
    edge = inside[1:] != inside[:-1]
    starts_here = edge & inside[1:]
    ends_here = edge & inside[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    joined = bounds[inside[bounds] & inside[bounds + 1]]
    starts_here[joined] = True
    ends_here[joined] = True
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here)
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(False, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * _power(True, n + 1)[starts] + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive word hashes (``len(words) - n + 1`` values)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _power(False, len(words)), out=prefix[1:])
    return mix((prefix[n:] - prefix[:-n]) * _power(True, m) + np.uint64(n))
