"""Connected components of a table of links.

Each round, tasks replace the links they read by a forest (every node points to the smallest one it
is joined to there); a node that has several such roots joins them, and pointers skip one step. Links
shrink to one for a node, and paths to less than half, in a round; the driver sees a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stored

#: Links of which a task makes one forest, at most.
TOGETHER = 1 << 21


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node that links join each to, for those that aren't it."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        apart = low < high
        u, v = u[apart], v[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []

    def told() -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x.column(c).to_numpy() for x in held)]) for c in ("a", "b"))
        node, root = forest(a, b)
        held.clear()
        yield from pa.table({"a": node, "b": root}).to_batches(max_chunksize=1 << 16)

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= TOGETHER:
            yield from told()
    yield from told()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of a link; ``root`` is the smallest node reachable.

    links: columns ``a`` and ``b``; links of a node to itself count for nothing. Raises if the
    rounds don't suffice (they take the logarithm of the longest path).
    """
    at = links.where("a <> b").select("a", "b")
    for _ in range(rounds):
        local = stored(at.mapInArrow(_forests, "a bigint, b bigint"), "forests")
        least = local.groupBy("a").agg(F.min("b").alias("m"))
        several = local.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moves"))
        next_ = least.select(F.col("a").alias("m"), F.col("m").alias("n"))
        skipped = least.join(next_, "m", "left").select("a", F.coalesce("n", "m").alias("b"), F.col("n").isNotNull().alias("moves"))
        seen = Observation()
        both = stored(several.union(skipped).observe(seen, F.count_if("moves").alias("moves")), "links")
        at = both.select("a", "b")
        if not seen.get["moves"]:
            return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(at.select("b", "b")).distinct()
    raise RuntimeError(f"components after {rounds} rounds")


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``node, root`` after further links ``a, b``, whose ends may be new."""
    ends = links.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
    over = stored(components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))), "over")
    moved = roots.join(over.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return stored(moved.union(over.join(roots, "node", "left_anti")), "roots")
