"""Connected components of an edge table, by alternating large-star and small-star steps, and what joins that compare
large groups in tiles need."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipewright.llm._shared import written


def components(edges: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: longs); a component is named by its smallest node.

    Each round writes its edges to the shared folder; the number of rounds is logarithmic in the longest chain.  No more
    than ``limit`` different edges (16 bytes each) are labelled on the driver instead: the same result without rounds.
    Self-loops and repeated edges are allowed; an empty table gives an empty result.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if edges.count() <= limit:
        table = edges.toArrow()
        nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
        i, j = spanning(ends[: table.num_rows], ends[table.num_rows :], len(nodes))
        label = np.arange(len(nodes))
        label[j] = i
        return edges.sparkSession.createDataFrame(pa.table({"node": nodes.astype(np.int64), "component": nodes[label].astype(np.int64)}), "node long, component long")
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        # Large star: every larger neighbour is linked to the smallest node of the neighbourhood.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the same for the smaller neighbours and the node itself.
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("x"), "m", "a")
        linked = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = written(linked, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before = tuple(state)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def spanning(i: np.ndarray, j: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A star forest with the same components as the pairs."""
    label = np.arange(m)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = np.minimum(new, new[label])
        if (new == label).all():
            break
        label = new
    touched = np.flatnonzero(label != np.arange(m))
    return label[touched], touched


def tiles(rows: DataFrame, name: str, member: str, blocks: str) -> DataFrame:
    """``rows`` dealt to ``blocks`` blocks each, once for every other block: ``tile`` names the pair of blocks, ``side``
    the row's own one in it, and ``own`` holds in one tile of each block, in which its inner pairs count.  A single
    block is one tile."""
    block = F.pmod(F.xxhash64(F.lit("tile"), F.col(member)), F.col(blocks))
    one = rows.withColumn("__p", block).withColumn("__q", F.explode(F.when(F.col(blocks) > 1, F.filter(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1), lambda q: q != F.col("__p"))).otherwise(F.array(F.lit(0).cast("long")))))
    low, high = F.least("__p", "__q"), F.greatest("__p", "__q")
    own = F.when(F.col(blocks) <= 1, True).otherwise((F.col("__p") == low) & (high == low + 1) | (F.col("__p") == high) & (low == 0) & (high == F.col(blocks) - 1))
    return one.withColumn("tile", F.xxhash64(F.col(name), low, high)).withColumn("side", F.col("__p") == low).withColumn("own", own).drop("__p", "__q")


def settled(found: DataFrame) -> DataFrame:
    """(node, component, n_links) of what a comparison in tiles found: rows (node, itself, links, ...), to be summed
    up, and edges (a, b, 0, whole), of which those of undivided components (whole) lead to the component's name."""
    found = written(found, "verified")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    edges = found.where("a <> b")
    stars = edges.where("whole").select(F.col("b").alias("node"), F.col("a").alias("component"))
    stars = stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
    split = edges.where("not whole").select("a", "b")
    if not split.isEmpty():
        stars = stars.unionAll(written(components(split), "groups"))
    return stars.join(links, "node")
