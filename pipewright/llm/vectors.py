"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors at squared distance r2 have, in any split of a rotated space into blocks, at least one block in
which their squared distance is at most the block's proportional share of r2.  Each block is a low-dimensional
range join on a grid; a cell compares its vectors in one byte a coordinate, within the error that this can have.  The
union of the candidates is verified exactly, component by component.  Nothing within the threshold is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright import ship
from pipewright.llm._shared import BROADCAST_BYTES, grouped_arrow, map_arrow, small_or_plain, written
from pipewright.llm._text import mix
from pipewright.llm.components import components, settled, spanning, tiles

_U = np.uint64
#: Side of a grid cell, in radii of the range join.
_SIDE = 2.0
#: Coordinates that are compared first: a distance in them is one at most in all.
_FEW = 32
#: Vectors in one cell, and in one block of a component, above which they are compared in tiles.
CELL_ROWS, _TILE_ROWS = 16384, 2000


def rotation(dim: int, seed: int = 20) -> np.ndarray:
    """A random rotation, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(seed + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.asarray(column.offsets, dtype=np.int64)
    return np.asarray(column.values, dtype=np.float64), offsets


def block_cells(x: np.ndarray, radius: float, dims: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home) of each grid cell, over the first ``dims`` coordinates, that a ball around a row meets:
    its own cell (home), and those of the others that come after it in the order of cell numbers."""
    side = _SIDE * radius
    at = np.floor(x[:, :dims] / side)
    low = x[:, :dims] - at * side  # distance to the lower neighbour
    index = np.arange(len(x))
    cell = np.full(len(x), mix(np.array([salt], dtype=np.uint64))[0])
    spent = np.zeros(len(x))
    moved = np.zeros(len(x), dtype=bool)
    for d in range(dims):
        parts = []
        for step in (0, -1, 1):
            gap = np.zeros(len(index)) if step == 0 else (low[index, d] if step < 0 else side - low[index, d])
            cost = spent + gap * gap
            ok = np.flatnonzero(cost <= radius * radius)
            code = (at[index[ok], d] + step).astype(np.int64).view(np.uint64)
            parts.append((index[ok], mix(cell[ok] ^ mix(code + _U(d + 1))), cost[ok], moved[ok] | (step != 0)))
        index, cell, spent, moved = (np.concatenate(p) for p in zip(*parts, strict=True))
    own = np.zeros(len(x), dtype=np.uint64)
    own[index[~moved]] = cell[~moved]
    keep = ~moved | (cell > own[index])
    return index[keep], cell[keep], ~moved[keep]


def _cells(sets: DataFrame, r2: float, block: int, grid: int, only_cells: bool = False) -> DataFrame:
    """(cell, id, home, scale, q) of every vector, block and cell: ``q`` is the rotated unit vector in signed bytes, to
    be multiplied by ``scale``.  With ``only_cells`` the first column alone."""

    def run(batch: pa.RecordBatch):
        values, offsets = _lists(batch.column("v"))
        ids = np.asarray(batch.column("id"))
        size = np.diff(offsets)
        for dim in np.unique(size).tolist():
            rows = np.flatnonzero(size == dim)
            x = values[(offsets[rows][:, None] + np.arange(dim)).ravel()].reshape(-1, dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            x = x @ rotation(dim)
            scale = np.abs(x).max(axis=1) / 127
            q = np.rint(x / scale[:, None]).astype(np.int8)
            for b in range(0, dim, block):
                part = x[:, b : b + block]
                width = part.shape[1]
                row, cell, home = block_cells(part, math.sqrt(r2 * width / dim) + 1e-9, min(grid, width), dim * 4096 + b)
                columns = [pa.array(cell.view(np.int64))]
                if not only_cells:
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(row), [None, pa.py_buffer(np.ascontiguousarray(q[row]))]).cast(pa.binary())
                    columns += [pa.array(ids[rows][row]), pa.array(home), pa.array(scale[row].astype(np.float32)), packed]
                yield pa.RecordBatch.from_arrays(columns, names=["cell", "id", "home", "scale", "q"][: len(columns)])

    return map_arrow(sets.select("id", "v"), run, "cell long" if only_cells else "cell long, id long, home boolean, scale float, q binary")


def _candidates(cells: DataFrame, r2: float, parts: int) -> DataFrame:
    """(a, b): edges that connect, cell by cell, the vectors that may be within the radius of one another."""

    r = math.sqrt(r2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_arrow(batches, "cell"):
            cell, ids, home, scale = (table.column(c).to_numpy() for c in ("cell", "id", "home", "scale"))
            packed = table.column("q").combine_chunks()
            packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
            at = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + len(cell) + 1]
            data = np.frombuffer(packed.buffers()[2], dtype=np.int8)
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            last = np.r_[first[1:], len(cell)]
            ones = np.add.reduceat(home, first, dtype=np.int64)
            for k in np.flatnonzero((last - first > 1) & (ones > 0)).tolist():
                a, b = int(first[k]), int(last[k])
                dim = int(at[a + 1] - at[a])
                s = scale[a:b]
                x = data[at[a] : at[b]].reshape(-1, dim).astype(np.float32) * s[:, None]
                # Half a step of rounding in each coordinate, and that of the arithmetic itself.
                error = s * np.float32(0.5 * math.sqrt(dim)) + np.float32(1e-4)
                h = np.flatnonzero(home[a:b])
                few = min(dim, _FEW)
                y = x[:, :few]
                # |x - h| <= r + ex + eh, with (ex + eh)^2 at most twice the sum of the squares, as one product.
                term = ((y**2).sum(axis=1) - 2 * r * error - 2 * error**2) / 2
                left = np.c_[y, -term, np.ones(b - a, np.float32)]
                right = np.c_[y[h], np.ones(len(h), np.float32), -term[h]].T.copy()
                step = max(1, (4 << 20) // len(h))
                ii, jj = [], []
                for c in range(0, b - a, step):
                    i, j = np.nonzero(left[c : c + step] @ right >= np.float32(-r * r / 2 - 1e-5))
                    i += c
                    j = h[j]
                    ok = i != j
                    i, j = i[ok], j[ok]
                    for p in range(0, len(i), 1 << 18):
                        u, v = i[p : p + (1 << 18)], j[p : p + (1 << 18)]
                        near = np.sqrt(((x[u] - x[v]) ** 2).sum(axis=1)) <= r + error[u] + error[v]
                        ii.append(u[near])
                        jj.append(v[near])
                if not ii:
                    continue
                i, j = np.concatenate(ii), np.concatenate(jj)
                if len(i):
                    i, j = spanning(i, j, b - a)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][i]), pa.array(ids[a:b][j])], names=["a", "b"])

    return cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _verified(sets: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b, links, whole) of all vectors that have a partner in their component, as ``settled`` takes it."""
    named = groups.select(F.col("node").alias("id"), "component")
    sizes = named.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / F.lit(_TILE_ROWS)).alias("blocks"))
    member = tiles(named.join(sizes, "component"), "component", "id", "blocks").select("id", "tile", "side", "own", (F.col("blocks") <= 1).alias("whole"))
    member = small_or_plain(written(member, "members"), 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_arrow(batches, "tile", 1024):
            tile, ids, side, own, whole = (table.column(c).to_numpy() for c in ("tile", "id", "side", "own", "whole"))
            values, offsets = _lists(table.column("v").combine_chunks() if not isinstance(table.column("v").combine_chunks(), pa.ChunkedArray) else table.column("v").combine_chunks().chunk(0))
            first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
            for a, b in zip(first.tolist(), np.r_[first[1:], len(tile)].tolist(), strict=True):
                dim = int(offsets[a + 1] - offsets[a])
                if b - a < 2 or (np.diff(offsets[a : b + 1]) != dim).any():
                    continue
                x = values[offsets[a] : offsets[b]].reshape(-1, dim)
                norm = np.sqrt((x * x).sum(axis=1))
                i, j = np.nonzero(np.triu(x @ x.T / (norm[:, None] * norm[None, :]) >= threshold - 1e-12, 1))
                ok = (side[a + i] != side[a + j]) | own[a + i]
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                links = np.bincount(i, minlength=b - a) + np.bincount(j, minlength=b - a)
                some = np.flatnonzero(links)
                p, q = spanning(i, j, b - a)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a + np.r_[some, p]]), pa.array(ids[a + np.r_[some, q]]), pa.array(np.r_[links[some], np.zeros(len(p), np.int64)]), pa.array(np.full(len(some) + len(p), bool(whole[a])))], names=["a", "b", "links", "whole"])

    vectors = sets.select("id", "v").join(member, "id").select("tile", "id", "side", "own", "whole", "v")
    return vectors.repartition("tile").sortWithinPartitions("tile", "id").mapInArrow(run, "a long, b long, links long, whole boolean")


def _rows(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v, id) of the rows with a key and a proper vector."""
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.col("key").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    # -0.0 and 0.0 are one number.
    return table.select(F.col(f"`{key}`").cast("long").alias("key"), v.alias("v")).where(fine).withColumn("v", F.transform("v", lambda c: c + F.lit(0.0))).withColumn("id", F.xxhash64("v"))


def _members(table: DataFrame, threshold: float, block: int, key: str, vector: str) -> DataFrame:
    """(key, class_id, copy_id, n_links) of every proper row."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = table.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _rows(table, key, vector)
    # Equal vectors are compared once; nothing of their rows is gathered but the smallest key.
    sets = written(rows.groupBy("v").agg(F.first("id").alias("id"), F.min("key").alias("copy_id")), "vectors")
    n = sets.count()
    grid = max(1, min(block, round(math.log(max(n, 1) / 2000 + 1) / math.log(3)) + 1))
    r2 = 2 * (1 - threshold) + 1e-9
    cells = _cells(sets, r2, block, grid)
    hot = written(_cells(sets, r2, block, grid, only_cells=True).groupBy("cell").count().where(F.col("count") > CELL_ROWS), "large-cells")
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot * 16 <= BROADCAST_BYTES else hot
        large = cells.join(hot, "cell").withColumn("blocks", F.ceil(F.col("count") / F.lit(CELL_ROWS // 2)))
        edges = _candidates(cells.join(hot, "cell", "left_anti"), r2, parts).unionAll(_candidates(tiles(large, "cell", "id", "blocks").select(F.col("tile").alias("cell"), "id", "home", "scale", "q"), r2, parts))
    else:
        edges = _candidates(cells, r2, parts)
    groups = written(components(written(edges, "candidates")), "groups")
    stars = settled(_verified(sets, groups, threshold))
    of = written(sets.select("id", "copy_id").join(stars, F.col("id") == F.col("node"), "left").select("id", "copy_id", F.coalesce("component", "id").alias("c"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "linked")
    classes = small_or_plain(written(of.join(of.groupBy("c").agg(F.min("copy_id").alias("class_id")), "c").select("id", "copy_id", "class_id", "n_links"), "classes"), 48)
    return rows.select("key", "id").join(classes, "id").select("key", "class_id", "copy_id", "n_links").distinct()


def similar_vectors(table: DataFrame, threshold: float = 0.97, block: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, class_id, copy_id, n_links): one row for each vector.

    ``copy_id`` is the smallest key with the same components, ``n_links`` the number of other vectors (of different
    components) with a cosine of at least ``threshold``, and ``class_id`` the smallest key that can be reached over
    such links and equal vectors; a vector that is like no other is its own class.

    Vectors are compared with those of the same length.  Null keys, null and empty vectors, and vectors with a
    null, NaN or infinite component or of length zero have no row; repeated rows have one; a key with several
    different vectors has a row for each of their results; an empty table gives an empty result; other columns are
    ignored.  ``key`` must be an integer, ``threshold`` above 0.

    The grid has more dimensions the more vectors there are.  A cell of more than ``CELL_ROWS`` rows, known by a count
    before the shuffle, is compared in tiles of two blocks, and so is a large component; no pairs are written.
    """
    return _members(table, threshold, block, key, vector).withColumnRenamed("key", key)


def deduplicate_vectors(table: DataFrame, threshold: float = 0.97, block: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows of ``table``, columns unchanged, with one vector of each class of :func:`similar_vectors`: that with the
    smallest key.  Rows that it leaves out stay, and so do all rows of the key that stays."""
    gone = _members(table, threshold, block, key, vector).where("key <> class_id").select(F.col("key").alias("__gone")).distinct()
    gone = small_or_plain(written(gone, "near-vectors"), 16)
    return table.join(gone, table[f"`{key}`"].cast("long") == gone["__gone"], "left_anti")
