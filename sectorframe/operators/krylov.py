"""Eigenpairs of operators that are given as functions of tables, all sectors in the same jobs.

An operator takes and returns columns ``(sector, i, k, v)`` of any number k, or packed ones (see ``blocks``). A block of random
columns, as many as pairs are asked for and some more, grows to a Krylov basis, block by block; each
sector's projected operator is solved in a task. Its best vectors begin the next basis, with their
images known: what has converged is locked, so it is no longer multiplied on, and of the others the
residuals go on, beside fresh random columns. Values count as found when nothing is left to go on and
the fresh columns have shown nothing larger; so a value that repeats is found as often as it repeats.

A sector's basis lies in parts of bounded rows, each one row of a table that is written once a step, with the products of
its columns beside them. These are summed in tasks first, and a sector's small matrices go once to each of its parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import binary, in_parts, kind_of, matrix, one_row, packed_cells, packed_index, random_lines, rows_of
from .lineage import cut, drop, written

#: Random columns beside those asked for, and columns of a basis at least.
EXTRA, BASIS = 2, 36
#: Bytes of a part's basis and images, and rows of a part at most, about.
SIZE, ROWS = 8 << 20, 1 << 14
#: Bytes of sums that a task holds before it passes them on.
HELD = 32 << 20
#: Columns under this share of their length before, when made orthogonal by products of columns, are rounding.
ROUNDING = 1e-7

# A part: its indices, the basis ``q`` of ``s`` columns, its images ``y``, columns ``z`` that are to join it, and products ``g`` of all
# these. The basis' last ``new`` columns are its newest; ``z`` begins with ``r`` residuals of ``m`` values, the largest being ``top``.
_NUMBERS = {"s": "bigint", "new": "bigint", "r": "bigint", "m": "bigint", "top": "double"}
_STATE = "part bigint, idx binary, q binary, y binary, z binary, g binary, " + ", ".join(f"{c} {t}" for c, t in _NUMBERS.items())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for row in rows_of(batches):
        yield row | {c: matrix(row[c], len(row["idx"])) for c in ("q", "y", "z")}


def _part(kind: pa.DataType, row: dict, q: np.ndarray, y: np.ndarray, z: np.ndarray, new: int = 0, r: int = 0, m: int = 0, top: float = 0.0) -> pa.RecordBatch:
    w = np.hstack([q, y, z])
    return one_row(kind, sector=row["sector"], part=row["part"], idx=row["idx"], q=binary(q), y=binary(y), z=binary(z), g=binary(w.T @ w), s=q.shape[1], new=new, r=r, m=m, top=top)


def _next(row: dict) -> np.ndarray:
    """A part of the columns that join the basis."""
    w = np.hstack([row["q"], row["y"], row["z"]])
    return w @ matrix(row["c"], w.shape[1]) if row["width"] else np.zeros((len(w), 0))


class _Krylov:
    def __init__(self, index: DataFrame, n: int, tol: float, side: int):
        self.kind, self.arrow = kind_of(index)
        self.n, self.tol, self.wide = n, tol, n + EXTRA
        self.packed, self.counts = "idx" in index.columns, None
        if not self.packed:
            rows = max(256, min(ROWS, SIZE // (16 * side)))
            counts = index.groupBy("sector").agg(F.ceil(F.count("*") / rows).cast("bigint").alias("parts"))
            self.counts = cut(counts)
            self.tasks = int(self.counts.agg(F.sum("parts")).head()[0] or 1)
            index = packed_index(self.placed(index).select("sector", "part", "i"), self.tasks)
        else:
            self.tasks = max(1, index.count())
        self.index, self.state = index, f"sector {self.kind}, {_STATE}"

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows ``sector, i`` with the part in which their index lies."""
        return rows.join(self.counts, "sector").withColumn("part", F.pmod(F.xxhash64("i"), "parts")).drop("parts")

    def begun(self) -> tuple[DataFrame, str]:
        """All parts, with an empty basis and random columns to begin it."""
        kind, wide = self.arrow, self.wide

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                none = np.zeros((len(row["idx"]), 0))
                yield _part(kind, row, none, none, random_lines(row["idx"], wide, 0))

        return written(self.index.select("sector", "part", "idx").mapInArrow(run, self.state), large=True)

    def summed(self, state: DataFrame, solve: Callable[[np.ndarray, dict], dict], fields: str) -> DataFrame:
        """``sector`` and ``fields``: what ``solve`` makes of the sum of a sector's products, and of its numbers. Tasks sum what they
        read, then a sector's sums meet. Written."""
        kind, names = self.arrow, list(_NUMBERS)
        fields_of = ", ".join(f"{c} {t}" for c, t in _NUMBERS.items())

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}

            def passed() -> Iterator[pa.RecordBatch]:
                for g, row in held.values():
                    yield one_row(kind, **row, g=binary(g))
                held.clear()

            for row in rows_of(batches):
                g, key = np.frombuffer(row.pop("g"), np.float64), row["sector"]
                held[key] = (held[key][0] + g if key in held else g, row)
                if sum(x.nbytes for x, _ in held.values()) > HELD:
                    yield from passed()
            yield from passed()

        def whole(rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.float64) for x in rows["g"])
            side = int(np.sqrt(total.size))
            return pd.DataFrame([{"sector": rows["sector"].iloc[0], **solve(total.reshape(side, side), {k: rows[k].iloc[0] for k in names})}])

        sums = state.select("sector", *names, "g").mapInArrow(partial, f"sector {self.kind}, {fields_of}, g binary")
        return cut(sums.groupBy("sector").applyInPandas(whole, f"sector {self.kind}, {fields}"))

    def orthonormal(self, state: DataFrame) -> DataFrame:
        """``sector, c, width, off``: by what columns of a part are to be multiplied to be those that join the basis: what is to
        join it, or the last images, made orthonormal beside it. ``off``: lengths of the residuals; locked ones don't join."""
        tol = self.tol

        def solve(g: np.ndarray, row: dict) -> dict:
            s, new, r, m = (int(row[c]) for c in ("s", "new", "r", "m"))
            joins = np.arange(2 * s, len(g)) if len(g) > 2 * s else np.arange(2 * s - new, 2 * s)
            length = np.sqrt(np.maximum(np.diag(g), 0))[2 * s : 2 * s + r]
            # Imaginary parts of the residuals, where there are any, follow the real ones.
            off = np.hypot(length[:m], length[m:]) if r > m else length
            locked = np.tile(off <= tol * row["top"], r // max(1, m))
            joins = np.delete(joins, np.flatnonzero(locked))
            of, to = g[:s, :s], g[:s, joins]
            share = np.linalg.lstsq(of, to, rcond=None)[0] if s else np.zeros((0, len(joins)))
            rest = g[np.ix_(joins, joins)] - to.T @ share
            size, was = np.sqrt(np.maximum(np.diag(rest), 0)), np.sqrt(np.diag(g)[joins])
            ok = size > ROUNDING * was
            size = np.where(ok, size, np.inf)
            values, vectors = np.linalg.eigh(rest / np.outer(size, size)) if len(size) else (size, rest)
            own = values > 1e-12 * max(values.max(initial=0), 1e-300)
            part = vectors[:, own] * values[own] ** -0.5 / size[:, None]
            c = np.zeros((len(g), int(own.sum())))
            c[:s], c[joins] = -share @ part, part
            return {"c": binary(c), "width": c.shape[1], "off": off.tolist()}

        return self.summed(state, solve, "c binary, width bigint, off array<double>")

    def multiplied(self, state: DataFrame, small: DataFrame, matvec: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
        """The basis with the columns that join it, and their images beside the others'."""
        kind, packed = self.arrow, self.packed
        own = state.select("sector", "part", "idx", "q", "y", "z").join(small.select("sector", "c", "width"), "sector")

        def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _parts(batches):
                if row["width"]:
                    x = _next(row)
                    if packed:
                        yield one_row(kind, sector=row["sector"], part=row["part"], idx=row["idx"], x=binary(x))
                        continue
                    a, k = np.nonzero(x)
                    yield pa.RecordBatch.from_arrays([pa.array([row["sector"]] * len(a), kind), pa.array(row["idx"][a]), pa.array(k, pa.int64()), pa.array(x[a, k])], ["sector", "i", "k", "v"])

        image = matvec(own.mapInArrow(columns, f"sector {self.kind}, " + ("part bigint, idx binary, x binary" if packed else "i bigint, k bigint, v double")))
        if not packed:
            image = packed_cells(self.placed(image.select("sector", "i", "k", F.col("v").cast("double").alias("v"))), self.tasks)
        image = image.select("sector", "part", F.lit(1).alias("piece"), "idx", F.col("x").alias("q"), *[F.lit(None).cast("binary").alias(c) for c in ("y", "z", "c")], F.lit(0).cast("bigint").alias("width"))
        both = own.select("sector", "part", F.lit(0).alias("piece"), "idx", "q", "y", "z", "c", "width").union(image)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            row, out = None, None

            def told() -> pa.RecordBatch:
                q, y = np.hstack([row["q"], row["x"]]), np.hstack([row["y"], out])
                return _part(kind, row, q, y, np.zeros((len(q), 0)), row["width"])

            for piece in rows_of(batches):
                if not piece["piece"]:
                    if row is not None:
                        yield told()
                    row = piece | {c: matrix(piece[c], len(piece["idx"])) for c in ("q", "y", "z")}
                    row["x"] = _next(row)
                    out = np.zeros(row["x"].shape)
                elif row is not None and (piece["sector"], piece["part"]) == (row["sector"], row["part"]) and len(out):
                    x = matrix(piece["q"], len(piece["idx"]))
                    at = np.minimum(np.searchsorted(row["idx"], piece["idx"]), len(out) - 1)
                    known = row["idx"][at] == piece["idx"]
                    out[at[known], : x.shape[1]] += x[known]
            if row is not None:
                yield told()

        return written(in_parts(both, self.tasks, "piece").mapInArrow(run, self.state), large=True)

    def solved(self, state: DataFrame) -> DataFrame:
        """``sector, re, im, x, b``: best values of the projected operator, their vectors, and a basis of what they span."""
        n, keep = self.n, self.n + EXTRA

        def solve(g: np.ndarray, row: dict) -> dict:
            s = int(row["s"])
            size, turn = np.linalg.eigh(g[:s, :s])
            root = turn * size**-0.5 if s else turn
            h = root.T @ g[:s, s : 2 * s] @ root
            even = np.allclose(h, h.T, rtol=0, atol=1e-11 * np.abs(h).max(initial=0))
            values, vectors = np.linalg.eigh((h + h.T) / 2) if even else np.linalg.eig(h)
            order = np.argsort(-np.abs(values), kind="stable")
            order = order[np.abs(values[order]) > 1e-13 * np.abs(values).max(initial=0)]
            span = vectors[:, order[:keep]]
            if not even:  # a pair of conjugates spans two directions, a real vector one
                u, length, _ = np.linalg.svd(np.hstack([span.real, span.imag]), full_matrices=False)
                span = u[:, length > 1e-8]
            x = root @ vectors[:, order[:n]]
            return {"re": values[order[:n]].real.tolist(), "im": values[order[:n]].imag.tolist(), "x": binary(np.hstack([x.real, x.imag])), "b": binary(root @ span)}

        return self.summed(state, solve, "re array<double>, im array<double>, x binary, b binary")

    def restarted(self, state: DataFrame, found: DataFrame, seed: int) -> tuple[DataFrame, str]:
        """The best vectors with their images, and to join them: the residuals ``M x - l x`` and random columns."""
        kind, wide = self.arrow, self.wide

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _parts(batches):
                s, m = row["q"].shape[1], len(row["re"])
                b = matrix(row["b"], s)
                values = np.array(row["re"]) + 1j * np.array(row["im"])
                x = matrix(row["x"], s) if s else np.zeros((0, 2 * m))
                x = x[:, :m] + 1j * x[:, m:]
                r = row["y"] @ x - (row["q"] @ x) * values
                turning = any(row["im"])
                z = [r.real, *([r.imag] if turning else []), random_lines(row["idx"], wide, seed)]
                yield _part(kind, row, row["q"] @ b, row["y"] @ b, np.hstack(z), 0, m * (1 + turning), m, float(np.abs(values).max(initial=0)))

        own = state.select("sector", "part", "idx", "q", "y", "z").join(found, "sector")
        return written(own.mapInArrow(run, self.state), large=True)

    def vectors(self, state: DataFrame, found: DataFrame) -> DataFrame:
        kind = self.arrow

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _parts(batches):
                m, x = len(row["re"]), matrix(row["x"], row["q"].shape[1])
                re, im = row["q"] @ x[:, :m], row["q"] @ x[:, m:]
                a, k = np.nonzero((re != 0) | (im != 0))
                yield pa.RecordBatch.from_arrays([pa.array([row["sector"]] * len(a), kind), pa.array(row["idx"][a]), pa.array(k, pa.int64()), pa.array(re[a, k]), pa.array(im[a, k])], ["sector", "i", "k", "re", "im"])

        own = state.select("sector", "part", "idx", "q", "y", "z").join(found.select("sector", "re", "x"), "sector")
        return own.mapInArrow(run, f"sector {self.kind}, i bigint, k bigint, re double, im double")


def eigenpairs(matvec: Callable[[DataFrame], DataFrame], index: DataFrame, n: int, tol: float = 1e-9, most: int = 60, basis: int = BASIS) -> tuple[DataFrame, DataFrame]:
    """The n eigenpairs of largest magnitude of each sector's operator: values ``sector, pos, re, im, residual`` and unit
    vectors ``sector, i, k, re, im`` (k is the value's pos). Runs at once.

    ``matvec``: ``(sector, i, k, v)`` to the same, linear in v, for all columns k. ``index``: the ``sector, i`` that it
    acts on. Where ``index`` is packed, ``sector, part, idx``, ``matvec`` takes those parts with their columns ``x`` and returns pieces
    of the same parts, which are added (see ``Blocks.times``). Zeros (1e-13 of a sector's largest value) are left out, so a
    sector whose operator has fewer pairs gives fewer, and one on which it is nothing gives none. Values that repeat are told as often as they do; of those
    that tie with the n-th any are taken. Residuals are at most ``tol`` times the sector's largest value; if they aren't
    within ``most`` bases, of ``basis`` columns or three blocks at least, a ``ValueError`` tells in how many sectors. A step's
    basis is deleted when the next is written.
    """
    steps, before, seed = max(3, -(-basis // (n + EXTRA))), None, 0
    packed = "idx" in index.columns
    own = _Krylov(cut(index.select("sector", "part", "idx") if packed else index.select("sector", "i").distinct()), n, tol, (steps + 1) * (n + EXTRA))
    spark = own.index.sparkSession
    state, path = own.begun()
    small = own.orthonormal(state)
    for _ in range(most):
        last = steps if before is None else 3  # random columns beside what is locked show soon whether there is more
        for step in range(last):
            small = own.orthonormal(state) if step else small
            (state, new), old = own.multiplied(state, small, matvec), path
            drop(spark, old)
            path = new
        found = own.solved(state)
        seed += 1
        fresh, after = own.restarted(state, found, seed)
        small = own.orthonormal(fresh)
        found = found.join(small.select("sector", "off"), "sector")
        top = F.array_max(F.transform(F.arrays_zip("re", "im"), lambda x: F.hypot(x["re"], x["im"])))
        sizes = found.select("sector", F.coalesce(top, F.lit(0.0)).alias("top"), F.transform(F.arrays_zip("re", "im"), lambda x: F.hypot(x["re"], x["im"])).alias("sizes"), F.coalesce(F.array_max("off"), F.lit(0.0)).alias("off"))
        left = sizes.where(F.col("off") > tol * F.col("top")).count()
        if not left and before is not None:
            pairs = sizes.join(before.select("sector", F.col("sizes").alias("old")), "sector")
            larger = F.exists(F.arrays_zip("sizes", "old"), lambda x: x["sizes"] > F.coalesce(x["old"], F.lit(0.0)) + 10 * tol * F.col("top"))
            if pairs.where(larger).isEmpty():
                break
        before = None if left else sizes
        drop(spark, path)
        state, path = fresh, after
    else:
        raise ValueError(f"no convergence within {most} bases in {left} sectors")
    each = found.select("sector", F.posexplode(F.arrays_zip("re", "im", "off")).alias("pos", "x"))
    values = each.select("sector", F.col("pos").cast("bigint").alias("pos"), "x.re", "x.im", F.col("x.off").alias("residual"))
    values, vectors = cut(values), cut(own.vectors(state, found))
    for old in (path, after):
        drop(spark, old)
    return values, vectors
