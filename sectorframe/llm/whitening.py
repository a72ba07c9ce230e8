"""Whitening of embeddings by spectral divide and conquer.

The covariance of the fixed-point vectors is summed in tasks, of centred vectors, so that only a
matrix of one side a dimension reaches the driver. There the polar factor of the covariance less
a shift, found by the dynamically weighted Halley iteration with QR factors only (QDWH), tells which
directions lie over the shift and which under: its symmetric projector splits the space into two
invariant subspaces, each split again until its share of the covariance is a multiple of the
identity. Whitening is then one product of each vector with a broadcast matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Dimensions, at most: the covariance is one matrix on the driver, and a part of it is broadcast. More raises.
DIMENSIONS = 2048
SCALE, OFFSET = 64, 1_000_000
#: Variances under this share of the largest are rounding: a component that is whitened by one would be noise.
FLOOR = 1e-11
_EPS = float(np.finfo(float).eps)


def polar(a: np.ndarray, steps: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix that isn't singular, by QDWH."""
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = _EPS / np.sqrt(n)  # a bound of the least singular value; one that is smaller costs a step
    for _ in range(steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        h = np.sqrt(1 + d) + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d))))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
        after = b / c * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        after = (after + after.T) / 2
        moved = np.linalg.norm(after - x)
        x, low = after, min(1.0, low * (h + b * square) / (1 + c * square))
        if moved <= np.cbrt(5 * _EPS) and abs(1 - low) < 1e-8:
            break
    return x


def _parts(a: np.ndarray, shift: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """Bases of the invariant subspaces of a symmetric matrix over and under a shift; None where one is empty, or
    an eigenvalue is so near the shift that the subspaces aren't told apart."""
    n = len(a)
    over = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
    rank = int(round(float(np.trace(over))))
    if not 0 < rank < n:
        return None
    basis = random.standard_normal((n, rank))
    for _ in range(3):  # a projector's range after one product, but for unlucky starts
        whole, _ = np.linalg.qr(over @ basis, mode="complete")
        basis = whole[:, :rank]
    rest = whole[:, rank:]
    off = np.abs(rest.T @ a @ basis).max(initial=0)
    return (basis, rest) if off <= 64 * n * _EPS * np.linalg.norm(a, 2) else None


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, descending, and unit eigenvectors (columns) of a symmetric matrix. Of repeated values any basis."""
    a = (a + a.T) / 2
    size = np.linalg.norm(a, 2) if a.size else 0.0
    random = np.random.default_rng(13)

    def split(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, mean = len(m), float(np.trace(m)) / max(len(m), 1)
        if n <= 1 or np.abs(m - mean * np.eye(n)).max() <= 4 * _EPS * size:
            return np.diag(m).copy(), np.eye(n)
        spread = float(np.linalg.norm(m - mean * np.eye(n), 2))
        # The mean lies between the least and the largest value; the median of the diagonal halves better.
        shifts = [float(np.median(np.diag(m))), mean, *(mean + spread * random.uniform(-0.3, 0.3, 40))]
        found = next((x for s in shifts if (x := _parts(m, s, random)) is not None), None)
        if found is None:
            raise ArithmeticError(f"no shift splits a subspace of {n} dimensions")
        halves = []
        for basis in found:
            own = basis.T @ m @ basis
            values, vectors = split((own + own.T) / 2)
            halves.append((values, basis @ vectors))
        return np.concatenate([h[0] for h in halves]), np.hstack([h[1] for h in halves])

    values, vectors = split(a)
    order = np.argsort(-values, kind="stable")
    vectors, _ = np.linalg.qr(vectors[:, order]) if a.size else (vectors, None)  # rounding of many levels
    return np.einsum("ik,ij,jk->k", vectors, a, vectors, optimize=True), vectors


def _arrays(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    lists = batch.column(name)
    if batch.num_rows and (pc.list_value_length(lists).to_numpy() != dims).any():
        raise ValueError(f"vectors of other than {dims} dimensions")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)


def fixed_point(vectors: DataFrame) -> DataFrame:
    """``vec_id, x`` of whole vectors: each entry c as ``floor(64 c) + 1000000``; entries too large for that raise."""
    whole = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + OFFSET)
    return vectors.where(whole).select("vec_id", x.alias("x"))


def _gram(rows: DataFrame, name: str, dims: int, centre: np.ndarray | None = None, n: int = 1) -> np.ndarray:
    """The sum of outer products of rows, in the driver; ``n * row - centre`` over n in place of a row, where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            y = _arrays(batch, name, dims)
            if centre is not None:
                y = (n * y - centre) / n
            total += y.T @ y
        i, j = np.triu_indices(dims)
        if total.any():
            yield pa.RecordBatch.from_pydict({"i": pa.array(i.astype(np.int32)), "j": pa.array(j.astype(np.int32)), "v": pa.array(total[i, j])})

    out = np.zeros((dims, dims))
    for r in rows.select(name).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def _whitened(n: int, centre: np.ndarray, matrix: np.ndarray):
    """Rows' deviations and components."""
    dims, bound = len(centre), int(np.sqrt((2**63 - 1) // max(1, len(centre))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = n * _arrays(batch, "x", dims) - centre
            if np.abs(z).max(initial=0) <= bound:
                deviation = (z * z).sum(1)
            else:  # may not fit: exact or an error
                deviation = np.array([sum(int(v) ** 2 for v in row) for row in z], dtype=object)
            y = (z / n) @ matrix
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]) if y.shape[1] else np.zeros(len(y) + 1), pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "deviation": pa.array(deviation, pa.int64()), "w": lists})

    return run


def whitened(vectors: DataFrame, components: int = 32) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of each whole vector and component.

    ``vectors``: ``vec_id, embedding``; others are ignored, whatever their names. A vector that is null, or holds a
    null or an entry that isn't finite, takes no part; whole vectors must have one length. Null and repeated ids
    count like others. Directions without variance (up to rounding) can't be whitened: there are no components for
    them, so that a table of equal vectors, or an empty one, has no rows. Raises where a deviation doesn't fit a long.

    To the driver come the sums, the covariance and that of the whitened vectors, which tells the error.
    """
    x = stored(fixed_point(vectors), "fixed")
    n, dims, others = x.agg(F.count("*"), F.max(F.size("x")), F.min(F.size("x"))).head()
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not n or not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    if dims != others or dims > DIMENSIONS:
        raise ValueError(f"vectors of {others} to {dims} dimensions; all must have one length, of up to {DIMENSIONS}")
    centre = np.zeros(dims, np.int64)
    for r in x.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum("v").alias("s")).collect():
        centre[r.j] = r.s
    values, directions = eigenpairs(_gram(x, "x", dims, centre, n) / n)
    trace = float(values.sum())
    kept = min(components, int((values > FLOOR * max(values.max(), 0)).sum()))
    if not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    told = stored(x.mapInArrow(_whitened(n, centre, directions[:, :kept] / np.sqrt(values[:kept])), f"vec_id {kind}, deviation bigint, w array<double>"), "whitened")
    error = float(np.abs(_gram(told, "w", kept) / n - np.eye(kept)).max())
    shares = F.array(*[F.lit(float(v / trace)) for v in values[:kept]])
    each = told.select("vec_id", "deviation", F.posexplode("w").alias("component", "whitened"))
    return each.select("vec_id", (F.col("component") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", shares[F.col("component")].alias("explained"), F.lit(error).alias("identity_error"))
