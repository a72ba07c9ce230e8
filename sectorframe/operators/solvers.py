"""Systems ``A x = b``, sector by sector.

Small sectors are solved in a task each. Larger ones by conjugate gradients on the normal equations
of the matrix with rows of length one: products along its cells, with a few numbers for each
right side, all sectors in the same jobs, until every residual is under the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Indices of a sector that is solved in one task, at most.
DIRECT = 1024


def _column(b: DataFrame) -> DataFrame:
    return b if "k" in b.columns else b.withColumn("k", F.lit(0).cast("bigint"))


def _direct(cells: DataFrame, b: DataFrame) -> DataFrame:
    kind = cells.schema["sector"].dataType.simpleString()
    empty = {"i": pa.array([], pa.int64()), "k": pa.array([], pa.int64()), "v": pa.array([], pa.float64())}

    def run(own: pa.Table, right: pa.Table) -> pa.Table:
        if not len(own) or not len(right):
            return pa.table({"sector": pa.array([], own.schema.field("sector").type), **empty})
        name = own["sector"][0].as_py()
        i, j, ri, rk = own["i"].to_numpy(), own["j"].to_numpy(), right["i"].to_numpy(), right["k"].to_numpy()
        index, columns = np.unique(np.concatenate([i, j, ri])), np.unique(rk)
        m, x = np.zeros((len(index), len(index))), np.zeros((len(index), len(columns)))
        np.add.at(m, (np.searchsorted(index, i), np.searchsorted(index, j)), own["v"].to_numpy())
        np.add.at(x, (np.searchsorted(index, ri), np.searchsorted(columns, rk)), right["v"].to_numpy())
        if np.linalg.matrix_rank(m) < len(index):
            raise ValueError(f"the matrix of sector {name} is singular")
        out = np.linalg.solve(m, x)
        a, c = np.nonzero(out)
        return pa.table({"sector": pa.array([name] * len(a), own.schema.field("sector").type), "i": pa.array(index[a]), "k": pa.array(columns[c]), "v": pa.array(out[a, c])})

    return cells.groupBy("sector").cogroup(b.groupBy("sector")).applyInArrow(run, f"sector {kind}, i bigint, k bigint, v double")


def _times(cells: DataFrame, x: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """``sector, i, k, v``: products with a column of ``x``; row and column tell which side is summed over."""
    right = x.select("sector", F.col("i").alias(column), "k", F.col(value).alias("_x"))
    return cells.join(right, ["sector", column]).groupBy("sector", F.col(row).alias("i"), "k").agg(F.sum(F.col("v") * F.col("_x")).alias("v"))


def _iterated(cells: DataFrame, b: DataFrame, tol: float, most: int) -> DataFrame:
    lengths = cells.groupBy("sector", "i").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_l"))
    a = cut(cells.join(lengths, ["sector", "i"]).select("sector", "i", "j", (F.col("v") / F.col("_l")).alias("v")))
    own = b.join(lengths, ["sector", "i"], "left")
    if not own.where("_l IS NULL AND v <> 0").isEmpty():
        raise ValueError("a row of b has no cells in its sector")
    r = own.where("_l > 0").select("sector", "i", "k", (F.col("v") / F.col("_l")).alias("v"))
    sides = cut(r.groupBy("sector", "k").agg(F.sum(F.col("v") * F.col("v")).alias("of_b")).where("of_b > 0"))
    index = a.select("sector", "i").union(a.select("sector", "j")).distinct()
    state = index.join(sides.select("sector", "k"), "sector").join(r.withColumnRenamed("v", "r"), ["sector", "i", "k"], "left").select("sector", "i", "k", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r"))

    def with_z(s: DataFrame) -> DataFrame:
        return s.join(_times(a, s, "j", "i", "r").withColumnRenamed("v", "z"), ["sector", "i", "k"], "left").withColumn("z", F.coalesce("z", F.lit(0.0)))

    state = cut(with_z(state).withColumn("p", F.col("z")))
    for step in range(most):
        told = cut(state.groupBy("sector", "k").agg(F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("z") * F.col("z")).alias("zz")).join(sides, ["sector", "k"]))
        left = told.where(F.col("rr") > tol * tol * F.col("of_b"))
        if left.isEmpty():
            return state.where("x <> 0").select("sector", "i", "k", F.col("x").alias("v"))
        if not left.where("zz <= 1e-30 * rr").isEmpty():
            raise ValueError("a sector's matrix is singular")
        w = cut(state.join(_times(a, state, "i", "j", "p").withColumnRenamed("v", "w"), ["sector", "i", "k"], "left").withColumn("w", F.coalesce("w", F.lit(0.0))))
        ww = w.groupBy("sector", "k").agg(F.sum(F.col("w") * F.col("w")).alias("ww"))
        # A side that is solved stands still.
        alpha = told.join(ww, ["sector", "k"]).select("sector", "k", F.when((F.col("ww") > 0) & (F.col("rr") > tol * tol * F.col("of_b")), F.col("zz") / F.col("ww")).otherwise(0.0).alias("alpha"), F.col("zz").alias("old"))
        moved = w.join(alpha, ["sector", "k"]).select("sector", "i", "k", (F.col("x") + F.col("alpha") * F.col("p")).alias("x"), (F.col("r") - F.col("alpha") * F.col("w")).alias("r"), "p", "old")
        state = cut(with_z(moved))
        beta = state.groupBy("sector", "k").agg(F.sum(F.col("z") * F.col("z")).alias("zz"), F.first("old").alias("old")).select("sector", "k", F.when(F.col("old") > 0, F.col("zz") / F.col("old")).otherwise(0.0).alias("beta"))
        state = state.join(beta, ["sector", "k"]).select("sector", "i", "k", "x", "r", "z", (F.col("z") + F.col("beta") * F.col("p")).alias("p"))
    raise ValueError(f"no solution to {tol} within {most} steps in {left.select('sector').distinct().count()} sectors")


def solve(cells: DataFrame, b: DataFrame, by: str | None = None, tol: float = 1e-10, most: int = 500, direct: int = DIRECT) -> DataFrame:
    """``x`` of ``A x = b``: cells ``(i, v)``, or ``(i, k, v)`` where ``b`` has several columns k; of each sector where ``by`` is given.

    cells: ``(i, j, v)`` of a square matrix; b: ``(i, v)`` or ``(i, k, v)``. Absent cells are zeros, also in the result. A sector
    without ``b`` has nothing to solve; one that only ``b`` has raises a ``ValueError``, as does a singular matrix. Sectors
    of up to ``direct`` indices are solved in a task, others until residuals are under ``tol`` times the length of ``b``, both
    over rows of length one; more than ``most`` steps raise. Runs at once.
    """
    own = cells.select(F.lit(0).alias("sector") if by is None else F.col(by).alias("sector"), "i", "j", F.col("v").cast("double").alias("v")).where("v <> 0")
    right = _column(b).select(F.lit(0).alias("sector") if by is None else F.col(by).alias("sector"), "i", "k", F.col("v").cast("double").alias("v"))
    if not right.select("sector").distinct().join(own.select("sector").distinct(), "sector", "left_anti").isEmpty():
        raise ValueError("a sector of b has no matrix")
    sizes = own.select("sector", "i").distinct().groupBy("sector").agg(F.count("*").alias("n"))
    sizes = cut(sizes)
    small, large = (sizes.where(c).select("sector") for c in (F.col("n") <= direct, F.col("n") > direct))
    out = _direct(own.join(small, "sector", "left_semi"), right.join(small, "sector", "left_semi"))
    if not large.isEmpty():
        out = out.union(_iterated(own.join(large, "sector", "left_semi"), right.join(large, "sector", "left_semi"), tol, most))
    out = out if "k" in b.columns else out.drop("k")
    return out.drop("sector") if by is None else out.withColumnRenamed("sector", by)
