"""Exact top-k inner products from an impact-ordered index, score at a time.

A block of vectors is indexed by dimension: its rows in order of their integer there, so that
rows of one impact stand together as a segment. For a query, segments of all dimensions are
processed by descending contribution, level by level, into accumulators. What a dimension can
still add to a row is at most the level's bound, so a row whose accumulator plus all bounds is
under the k-th score that is surely reached can't be a member. The search stops when the rows
that still may be members are few, or when no positive contribution is left; these rows are
then scored exactly. Nothing is dropped without that proof.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of an indexed block and queries of a block, at most about; both are dealt by a hash.
ROWS, QUERIES = 8192, 512
#: Contribution levels, as shares of a query's largest possible contribution, descending.
LEVELS = (0.4, 0.2, 0.1, 0.05, 0.0)
#: The search stops when at most this share of a block's rows may be members.
FEW = 0.2
#: Scores under this are exact as doubles.
EXACT = 2.0**53


class Index:
    """One block: ``ids`` ascending, ``values`` rows x dimensions (integers as floats, exact)."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], np.ascontiguousarray(values[order])
        by_impact = np.argsort(self.values, axis=0, kind="stable")
        # Of each dimension, rows by ascending impact: a query's largest contributions stand at the end, or at the
        # beginning where its own component is negative.
        self.rows = np.ascontiguousarray(by_impact.T)
        self.impacts = np.ascontiguousarray(np.take_along_axis(self.values, by_impact, 0).T)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own, ties to the smaller id."""
        n, dims = self.values.shape
        q = query.astype(np.float64)
        largest = np.maximum(self.impacts[:, 0] * q, self.impacts[:, -1] * q)
        top = max(float(largest.max(initial=0.0)), 0.0)
        sums = np.zeros(n)
        at = np.zeros(dims, np.int64)
        maybe = np.arange(n)
        for share in LEVELS:
            bound = share * top
            rows, parts = [], []
            for d in np.flatnonzero((q != 0) & (largest > bound)).tolist():
                impacts = self.impacts[d]
                # Impacts are whole numbers: those whose contribution is over the bound.
                if q[d] > 0:
                    to = n - int(np.searchsorted(impacts, np.floor(bound / q[d]), "right"))
                    part = slice(n - to, n - at[d])
                else:
                    to = int(np.searchsorted(impacts, np.ceil(bound / q[d]), "left"))
                    part = slice(at[d], to)
                if to > at[d]:
                    rows.append(self.rows[d, part])
                    parts.append(impacts[part] * q[d])
                    at[d] = to
            if rows:
                sums += np.bincount(np.concatenate(rows), np.concatenate(parts), minlength=n)
            # Each dimension adds at most the bound more; a row already met there adds nothing more.
            rest = float(np.minimum(np.maximum(largest, 0), bound).sum())
            ahead = np.argpartition(-sums, min(n - 1, 4 * k))[: 4 * k + 1] if n > 4 * k + 1 else np.arange(n)
            exact = self.values[ahead] @ q
            exact = exact[self.ids[ahead] != own]
            if len(exact) < k:
                continue
            sure = np.partition(exact, len(exact) - k)[len(exact) - k]
            maybe = np.flatnonzero(sums + rest + 0.5 >= sure)  # scores are whole; the half is for rounding of bounds
            if len(maybe) <= FEW * n:
                break
        scores = self.values[maybe] @ q
        ok = self.ids[maybe] != own
        ids, scores = self.ids[maybe][ok], scores[ok]
        best = np.lexsort((ids, -scores))[:k]
        return ids[best], scores[best].astype(np.int64)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of one length as an array."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, rows: int = ROWS, of_queries: int = QUERIES) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the k best of all ``vectors`` for each of ``queries``.

    Both: ``vec_id bigint`` and ``vector array<bigint>``; callers leave out rows that take no
    part. A query's candidates are all rows of its length with another id than its own. Repeated
    ids are ranked as rows of their own, by score. An empty side gives an empty table. Components
    so large that a score could reach 2^53 raise.

    Blocks of queries meet blocks of rows in one task each, and only k results leave it for a
    query, so no task or shuffle grows with a hot vector. The work is that of the stated
    queries against all rows.
    """
    n, m = vectors.count(), queries.count()
    blocks, q_blocks = max(1, -(-n // rows)), max(1, -(-m // of_queries))
    # A salt by the vector too, lest rows of one id fall together.
    block = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int")
    q_block = F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")
    left = vectors.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), F.lit(False).alias("query"), F.size("vector").alias("d"), "vec_id", "vector")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), q_block.alias("q_block"), F.lit(True).alias("query"), F.size("vector").alias("d"), "vec_id", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        asks = table["query"].to_numpy(zero_copy_only=False)
        ids, values = table["vec_id"].to_numpy(), _matrix(table["vector"])
        if asks.all() or not asks.any():
            return
        if float(np.abs(values[asks]).max(initial=0.0)) * float(np.abs(values[~asks]).max(initial=0.0)) * values.shape[1] >= EXACT:
            raise ValueError("components so large that a score could reach 2^53, from where it wouldn't be exact")
        index = Index(ids[~asks], values[~asks])
        found = [(q, *index.search(v, q, k)) for q, v in zip(ids[asks].tolist(), values[asks], strict=True)]
        yield pa.RecordBatch.from_pydict(
            {"query_id": pa.array(np.repeat([q for q, *_ in found], [len(i) for _, i, _ in found]) if found else [], pa.int64()), "vec_id": pa.array(np.concatenate([i for _, i, _ in found]) if found else [], pa.int64()), "score": pa.array(np.concatenate([s for *_, s in found]) if found else [], pa.int64())}
        )

    met = left.unionByName(right).groupBy("block", "q_block", "d").applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, vector`` with floor(scale * x) of each component. Rows whose id or vector is null, or whose
    vector holds a null or non-finite component, are left out."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vector"))
