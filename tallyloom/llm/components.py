"""Connected components: blocks of edges become stars where they lie, then large and small stars alternate, one pair of joins a round.

A block has a fixed number of edges and one task, which holds no more than that and leaves each of its nodes one edge. What fits one block is
done with it; otherwise fewer rounds, each with several shuffles to be planned, are left for what crosses blocks. No neighbourhood is
ever gathered there: each round takes the least neighbour of every node with a partial aggregate and joins it back to the edges, so a node
with very many edges is a skewed join that Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import drop_written, shuffled, written

#: Edges that a task makes stars of at a time.
BLOCK = 1 << 18


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either the centre of its component or has one edge, to the centre."""
    end = lambda node, up: F.struct(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))
    nodes = edges.select(F.explode(F.array(end("a", 1), end("b", 0))).alias("e")).groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
    return not nodes.agg(F.count(F.when((F.col("up") > 0) & (F.col("up") + F.col("down") > 1), 1))).first()[0]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.join(shuffled(least), "a").where("b > a")
    return joined.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(shuffled(least), "a")
    pairs = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return pairs.select("e.a", "e.b").where("a > b").distinct()


def _stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges, and the least node that it can reach over them."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        u, v = root[x], root[y]
        apart = u != v
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(u, v)[apart], np.minimum(u, v)[apart])
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _in_blocks(edges: DataFrame, parts: int, block: int, centres: bool) -> DataFrame:
    """``a, b``: each node of a block and its least one there, which with ``centres`` has a row of its own. A task holds twice a block at most."""

    none = np.zeros(0, np.int64)

    def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        kept = slice(None) if centres else a != b
        return pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], names=["a", "b"])

    def of(batches):
        held, n = [(none, none)], 0
        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += batch.num_rows
            if n >= block:
                held, n = [_stars_of(*map(np.concatenate, zip(*held)))], 0
                if len(held[0][0]) > block:
                    yield rows(*held[0])
                    held = [(none, none)]
        yield rows(*_stars_of(*map(np.concatenate, zip(*held))))

    return edges.coalesce(parts).mapInArrow(of, "a long, b long")


def connected_components(links: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """``node, component`` for every node that has a link; ``component`` is its least reachable node.

    Links are pairs of longs without nulls; their order, repeats and self-links do not matter. Components found before may be
    given as links of nodes to them, beside new ones: no round is spent on what is a star already.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = written(links.where(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")), "edges")
    blocks = -(-edges.count() // block)
    if blocks <= 1:
        return _in_blocks(edges, 1, block, centres=True).toDF("node", "component")
    within = written(_in_blocks(edges, blocks, block, centres=False), "within")
    drop_written(edges)
    edges = within
    while not _all_stars(edges):
        stars = written(_small_star(_large_star(edges)), "stars")
        drop_written(edges)
        edges = stars
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
