"""Factorisations, grouped solvers, spectra and projections.

The long side of a matrix stays in Spark: what reaches the driver or one task is a Gram matrix
of the short side, or one group's matrix, whose size is checked first (``SMALL_SIDE``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import scale
from .aggregates import normalise
from .blocks import Blocks, binary, unpacked
from .joins import add, contract, shared_sectors
from .krylov import eigenpairs
from .lineage import cut
from .orthogonal import packed_qr, packed_svd, product, tall_qr, tall_svd
from .ranking import cut_multiplets

#: Indices of the short side, at most; more raises.
SMALL_SIDE = 2048
#: Singular values under this share of the largest are noise when found from a Gram matrix.
GRAM_FLOOR = float(np.sqrt(np.finfo(float).eps))


def gram(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``i, j, v``: the Gram matrix of the columns, for each group: a self-join on rows."""
    left = cells.select(*by, F.col("i").alias("_r"), F.col("j").alias("i"), F.col("v").alias("_a"))
    right = cells.select(*by, F.col("i").alias("_r"), "j", F.col("v").alias("_b"))
    return left.join(right, [*by, "_r"]).groupBy(*by, "i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def gram_of_arrays(df: DataFrame, array: str, by: Sequence[str] = ()) -> DataFrame:
    """The same for rows that are dense arrays of one length: sums of outer products within each batch, then over batches.

    Columns of groups must be integers or strings. Rows hold no nulls.
    """
    keys = list(by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, own in rows.groupby(keys, dropna=False) if keys else [((), rows)]:
                x = np.stack(own["_x"].to_list()).astype(np.float64)
                g = x.T @ x
                i, j = np.divmod(np.arange(g.size), len(g))
                yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "i": i, "j": j, "v": g.ravel()})

    fields = "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys)
    partial = df.select(*keys, F.col(array).cast("array<double>").alias("_x")).mapInPandas(run, f"{fields}i bigint, j bigint, v double")
    return partial.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def small_gram(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same as :func:`gram` for matrices of a short column side: a row's cells come together once, products are
    summed within each batch, then over batches. A batch with over ``SMALL_SIDE`` columns of one group raises."""
    keys = list(by)
    packed = cells.groupBy(*keys, "i").agg(F.collect_list(F.struct("j", F.col("v").cast("double").alias("v"))).alias("_row")).drop("i")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_row")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            j, v = (pc.struct_field(lists.flatten(), k).to_numpy(zero_copy_only=False) for k in (0, 1))
            group = pd.MultiIndex.from_arrays([batch.column(k).to_pandas() for k in keys]).factorize()[0] if keys else np.zeros(batch.num_rows, np.int64)
            order = np.argsort(group[row], kind="stable")
            row, j, v = row[order], j[order], v[order]
            edges = np.searchsorted(group[row], np.arange(int(group.max(initial=-1)) + 2))
            for g in range(len(edges) - 1):
                own = slice(edges[g], edges[g + 1])
                index, place = np.unique(j[own], return_inverse=True)
                if len(index) > SMALL_SIDE:
                    raise ValueError(f"short side over {SMALL_SIDE}")
                rows, line = np.unique(row[own], return_inverse=True)
                total = np.zeros((len(index), len(index)))
                for k in range(0, len(rows), 1024):
                    here = (line >= k) & (line < k + 1024)
                    x = np.zeros((min(1024, len(rows) - k), len(index)))
                    np.add.at(x, (line[here] - k, place[here]), v[own][here])
                    total += x.T @ x
                a, b = np.nonzero(total)
                one = int(np.flatnonzero(group == g)[0])
                columns = [pa.array([batch.column(c)[one].as_py()] * len(a), batch.schema.field(c).type) for c in keys]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(index[a], pa.int64()), pa.array(index[b], pa.int64()), pa.array(total[a, b])], [*keys, "i", "j", "v"])

    fields = "".join(f"{k} {cells.schema[k].dataType.simpleString()}, " for k in keys)
    partial = packed.select(*keys, "_row").mapInArrow(run, f"{fields}i bigint, j bigint, v double")
    return partial.groupBy(*keys, "i", "j").agg(F.sum("v").alias("v"))


def _square(rows: pd.DataFrame, limit: int = SMALL_SIDE) -> tuple[np.ndarray, np.ndarray]:
    """A group's square matrix from its cells ``i, j, v``, and its indices; raises beyond the bound."""
    index = np.unique(rows[["i", "j"]]).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    if len(index) > limit:
        raise ValueError(f"a group's matrix has over {limit} indices")
    out = np.zeros((len(index), len(index)))
    out[np.searchsorted(index, rows["i"]), np.searchsorted(index, rows["j"])] = rows["v"]
    return out, index


def _cells(spark, matrix: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> DataFrame:
    i, j = np.nonzero(matrix)
    table = pd.DataFrame({"i": rows[i].astype(np.int64), "j": cols[j].astype(np.int64), "v": matrix[i, j].astype(np.float64)})
    return spark.createDataFrame(table, "i bigint, j bigint, v double")


def _sectors(cells: DataFrame, by: str | None) -> DataFrame:
    return cells.select(F.lit(0).alias("sector") if by is None else F.col(by).alias("sector"), "i", "j", F.col("v").cast("double").alias("v"))


def _bare(cells: DataFrame, by: str | None) -> DataFrame:
    return cells.drop("sector") if by is None else cells.withColumnRenamed("sector", by)


def qr(cells: DataFrame, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Orthonormal ``Q`` and upper triangular ``R`` of one matrix or of each sector, of any rank and condition.

    From triangular factors of what each task reads, which meet up a tree, with column pivoting at its root; rows over
    that factor are factored once more, so that ``Q`` is orthonormal whatever the condition. Columns of ``Q`` and rows of
    ``R`` bear the index of the column that brought the direction, so there are as many as the rank (see :func:`ranks`); a
    column that depends on others (to ``16 n`` roundings of its length) brings none. A sector of zeros has no cells. An empty
    table gives empty factors. Up to 2,048 columns a sector; more raise. Runs at once.
    """
    q, r = tall_qr(_sectors(cells, by))
    return _bare(q, by), _bare(r, by)


def ranks(r: DataFrame, by: str = "sector") -> DataFrame:
    """``rank`` of each sector from its triangular factor; a sector of zeros isn't there."""
    return r.groupBy(by).agg(F.countDistinct("i").alias("rank"))


def rq(cells: DataFrame, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Lower triangular ``R`` and ``Q`` with orthonormal rows, such that ``R Q`` is the matrix: its transpose's QR."""

    def flipped(x: DataFrame) -> DataFrame:
        return x.select(*([by] if by else []), F.col("j").alias("i"), F.col("i").alias("j"), "v")

    q, r = qr(flipped(cells), by)
    return flipped(r), flipped(q)


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive, so that results don't hang on the solver."""
    if not vectors.size:
        return vectors
    top = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
    return vectors * (np.abs(top) / np.where(top == 0, 1, top))


def _right_vectors(rows: pd.DataFrame) -> pd.DataFrame:
    """Singular values and right vectors of one sector, from its Gram matrix."""
    g, index = _square(rows)
    values, vectors = np.linalg.eigh(g)
    values, vectors = np.sqrt(np.maximum(values[::-1], 0)), _signed(vectors[:, ::-1])
    n = int((values > GRAM_FLOOR * values.max(initial=0)).sum())
    return pd.DataFrame({"sector": rows["sector"].iloc[0], "pos": np.repeat(np.arange(n), len(index)), "s": np.repeat(values[:n], len(index)), "j": np.tile(index, n), "v": vectors[:, :n].T.ravel()})


def _decomposed(cells: DataFrame) -> DataFrame:
    """``sector, pos, s, j, v``: right vectors of each sector with their values."""
    kind = cells.schema["sector"].dataType.simpleString()
    return small_gram(cells, ["sector"]).groupBy("sector").applyInPandas(_right_vectors, f"sector {kind}, pos bigint, s double, j bigint, v double").checkpoint()


def _weights(found: DataFrame) -> DataFrame:
    return found.groupBy("sector", "pos").agg(F.first("s").alias("v")).select("sector", "pos", F.lit(1).alias("dim"), "v")


def _three(cells: DataFrame, found: DataFrame, by: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    right = found.select("sector", F.col("j").alias("i"), F.col("pos").alias("j"), "v")
    left = product(cells, found.select("sector", F.col("j").alias("i"), F.col("pos").alias("j"), (F.col("v") / F.col("s")).alias("v")))
    return _bare(left, by), _weights(found), _bare(right, by)


def svd(cells: DataFrame, by: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``U`` cells ``(i, j)``, weights ``(sector, pos, dim, v)`` descending, and ``V`` cells, of one matrix (sector 0) or of each sector.

    Values under ``GRAM_FLOOR`` times the largest can't be told from 0 this way and are dropped;
    :func:`accurate_svd` has them. The right vectors are checkpointed; ``U`` is made by parts of rows (see :func:`product`).
    """
    own = _sectors(cells, by)
    return _three(own, _decomposed(own), by)


def accurate_svd(cells: DataFrame, by: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same with small values: by rotations of the triangular factor of :func:`qr`, so that those down to rounding are
    there, as many as the rank, and vectors are orthonormal. Where a matrix is one of good condition with scaled columns,
    each value is right relative to itself. Runs at once."""
    u, s, v = tall_svd(_sectors(cells, by))
    return _bare(u, by), s, _bare(v, by)


def singular_values(cells: DataFrame, by: str = "sector") -> DataFrame:
    """Weights of every sector: one Gram matrix for each, its values found in a task of its own."""
    return _weights(_decomposed(_sectors(cells, by)))


def truncated_svd(cells: DataFrame, target: int, by: str | None = "sector", **cut) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``U``, weights and ``V`` of the largest singular values over all sectors, ties kept together (see
    ``cut_multiplets``, which runs small jobs at once). Sectors without a kept value vanish."""
    own = _sectors(cells, by)
    found = _decomposed(own)
    kept = cut_multiplets(_weights(found), target, **cut)
    return _three(own, found.join(kept.select("sector", "pos"), ["sector", "pos"], "left_semi").checkpoint(), by)


#: Columns of a sketch beside those asked for.
OVER = 10


def blocked(cells: DataFrame, by: str | None = None) -> Blocks:
    """The matrix, or each sector's, in blocks, for what reads it often; see :class:`sectorframe.operators.blocks.Blocks`. Runs at once."""
    return Blocks(cut(_sectors(cells, by)))


def randomized_svd(cells: DataFrame | Blocks, k: int, by: str | None = None, steps: int = 3, seed: int = 11, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``U``, weights and ``V`` of the k largest singular values over all sectors, for matrices large on both sides.

    A sketch of ``k + OVER`` columns, drawn by a hash of each index, finds the range: products with the matrix and its
    transpose in turn, ``steps`` times, each made orthonormal before the next. The matrix in that range has one short side,
    and its factors are those of :func:`accurate_svd`. Values that the sketch can't tell from those beyond it are
    a little low: by a factor of ``(s_{k + OVER} / s)^(4 steps + 2)`` in the square, about. Ties are kept together (see
    ``cut_multiplets`` for ``how``). No side is bounded but that of the sketch, 2,048. All columns of the sketch go in one row for
    thousands of indices, and cells in blocks (see :func:`blocked`, whose result may stand for the cells). Runs at once.
    """
    own = cells if isinstance(cells, Blocks) else blocked(cells, by)
    wide = k + OVER
    if wide > SMALL_SIDE:
        raise ValueError(f"sketch over {SMALL_SIDE}")
    flipped = own.flipped()
    rows, columns = own.tasks
    y = own.times(own.random(wide, seed))
    for _ in range(steps):
        q, _ = packed_qr(flipped.times(packed_qr(y, rows)[0]), columns)
        y = own.times(q)
    q, _ = packed_qr(y, rows)
    right, found = packed_svd(flipped.times(q), columns)
    kept = cut_multiplets(found.where("what = 's'").select("sector", F.col("j").alias("pos"), F.lit(1).alias("dim"), "v"), k, **how).checkpoint()
    small = found.where("what <> 's'").join(kept.select("sector", F.col("pos").alias("j")), ["sector", "j"], "left_semi")

    def told(table: pd.DataFrame) -> pd.DataFrame:
        names = np.unique(table["j"])
        out = []
        for what, part in table.groupby("what"):
            m = np.zeros((int(part["i"].max()) + 1, len(names)))
            m[part["i"], np.searchsorted(names, part["j"])] = part["v"]
            out.append({"sector": part["sector"].iloc[0], "what": what, "m": binary(m), "names": names.tolist()})
        return pd.DataFrame(out)

    turns = cut(small.groupBy("sector").applyInPandas(told, f"sector {own.kind}, what string, m binary, names array<bigint>"))
    u, v = (cut(unpacked(x, turns.where(F.col("what") == what))) for x, what in ((q, "v"), (right, "u")))
    return _bare(u, by), kept, _bare(v, by)


def left_out(cells: DataFrame | Blocks, u: DataFrame, weights: DataFrame, v: DataFrame, by: str | None = None) -> DataFrame:
    """``sector, lost``: the energy of cells less ``U s V^T``, the sum of all squares, for factors with any columns.

    The product is formed at the cells only: beside them stand the squares of the whole product, which come of the
    factors' Gram matrices. So the work grows with cells and factors, and not with rows times columns. Blocks are multiplied by
    ``V`` once, whose products with ``U s`` are those sums.
    """
    left, right = _sectors(u, by), _sectors(v, by)
    scaled = left.join(weights.select("sector", F.col("pos").alias("j"), F.col("v").alias("_s")), ["sector", "j"]).select("sector", "i", "j", (F.col("v") * F.col("_s")).alias("v"))

    whole = small_gram(scaled, ["sector"]).withColumnRenamed("v", "_a").join(small_gram(right, ["sector"]), ["sector", "i", "j"]).select("sector", (F.col("_a") * F.col("v")).alias("lost"))
    if isinstance(cells, Blocks):
        image = cells.image(right.withColumnRenamed("j", "k")).withColumnRenamed("k", "j")
        met = scaled.withColumnRenamed("v", "_u").join(image, ["sector", "i", "j"]).select("sector", (F.col("_u") * F.col("v") * -2.0).alias("lost"))
        return cells.energy().withColumnRenamed("energy", "lost").union(met).union(whole).groupBy("sector").agg(F.sum("lost").alias("lost"))

    def packed(x: DataFrame, leg: str, name: str) -> DataFrame:
        return x.groupBy("sector", F.col("i").alias(leg)).agg(F.map_from_entries(F.collect_list(F.struct("j", "v"))).alias(name))

    own = _sectors(cells, by).join(packed(scaled, "i", "_u"), ["sector", "i"], "left").join(packed(right, "j", "_v"), ["sector", "j"], "left")
    terms = F.transform(F.map_keys("_u"), lambda k: F.coalesce(F.col("_u")[k] * F.try_element_at("_v", k), F.lit(0.0)))
    here = F.coalesce(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
    at_cells = own.select("sector", (F.col("v") * (F.col("v") - 2 * here)).alias("lost"))
    return at_cells.union(whole).groupBy("sector").agg(F.sum("lost").alias("lost"))


def pairs_by_group(df: DataFrame, key: str, solve: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], schema: str, limit: int = SMALL_SIDE) -> DataFrame:
    """``key, pos, v, index, vector``: what a solver of the caller's own finds for each group's square matrix
    ``(key, i, j, v)``, by magnitude, exact zeros left out; ``vector`` has a component for each of ``index``.

    ``solve`` returns values and vectors as columns; ``schema`` is the type of a number. A group over ``limit``
    indices raises.
    """

    def told(x: np.ndarray) -> list:
        return [{"re": float(c.real), "im": float(c.imag)} for c in x] if schema.startswith("struct") else x.tolist()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        m, index = _square(rows, limit)
        values, vectors = solve(m)
        order = np.argsort(-np.abs(values), kind="stable")
        values, vectors = values[order], _signed(vectors[:, order])
        n = int((np.abs(values) > 0).sum())
        out = {"key": rows["key"].iloc[0], "pos": np.arange(n), "v": told(values[:n]), "index": [index.tolist()] * n, "vector": [told(vectors[:, k]) for k in range(n)]}
        return pd.DataFrame(out)

    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("key"), "i", "j", "v").groupBy("key").applyInPandas(run, f"key {kind}, pos bigint, v {schema}, index array<bigint>, vector array<{schema}>")
    return found.withColumnRenamed("key", key)


def eigh_by_group(df: DataFrame, key: str, limit: int = SMALL_SIDE) -> DataFrame:
    """Eigenvalues and unit vectors ``key, pos, v, index, vector`` of one symmetric matrix ``(key, i, j, v)`` for each group, by magnitude; exact zeros are dropped."""
    return pairs_by_group(df, key, np.linalg.eigh, "double", limit)


def eig_by_group(df: DataFrame, key: str, limit: int = SMALL_SIDE) -> DataFrame:
    """The same for any square matrices, with complex numbers ``struct<re, im>``."""

    def solve(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, vectors = np.linalg.eig(m)
        return values.astype(complex), vectors.astype(complex)

    return pairs_by_group(df, key, solve, "struct<re: double, im: double>", limit)


def power_steps(matvec: Callable[[DataFrame], DataFrame], start: DataFrame, steps: int) -> tuple[DataFrame, float]:
    """``steps`` normalised products of an operator ``(i, v) -> (i, v)`` with a vector, and the last step's norm."""
    x, size = start, 0.0
    for k in range(steps):
        x, log = normalise(matvec(x))
        size = float(np.exp(log))
        if k % 4 == 3:
            x = x.checkpoint()
    return x, size


def top_eigen(matvec: Callable[[DataFrame], DataFrame], start: DataFrame, n: int, tol: float = 1e-9, **how) -> tuple[DataFrame, DataFrame]:
    """The n eigenpairs of largest magnitude of an operator on columns ``(i, k, v)``, or on ``(sector, i, k, v)`` where
    ``start`` has sectors: values ``pos, re, im, residual`` and unit vectors ``i, k, re, im`` (k is the value's pos), of
    each sector where there are any. See :func:`sectorframe.operators.krylov.eigenpairs`; ``start`` has all indices ``i``
    that the operator may reach, whatever else.
    """
    if "sector" in start.columns:
        return eigenpairs(matvec, start, n, tol, **how)
    values, vectors = eigenpairs(lambda x: matvec(x.drop("sector")).withColumn("sector", F.lit(0)), start.select(F.lit(0).alias("sector"), "i"), n, tol, **how)
    return values.drop("sector"), vectors.drop("sector")


def solve_by_group(df: DataFrame, key: Sequence[str], xs: Sequence[str], y: str, targets: DataFrame | None = None) -> DataFrame:
    """Least squares with a constant in each group: ``coef`` (constant last) from sums of products.

    ``targets``: groups that must be there; raises if one has no rows. A group without enough
    rows for its unknowns gets null.
    """
    if targets is not None and not targets.select(*key).join(df.select(*key).distinct(), list(key), "left_anti").isEmpty():
        raise ValueError("a group without a matrix")
    columns = [*[F.col(x).cast("double") for x in xs], F.lit(1.0), F.col(y).cast("double")]
    m = len(columns)
    pairs = [(a, b) for a in range(m) for b in range(a, m)]
    sums = df.groupBy(*key).agg(*[F.sum(columns[a] * columns[b]).alias(f"s{a}_{b}") for a, b in pairs])
    return sums.select(*key, _solve_udf(pairs, m)(F.struct(*[f"s{a}_{b}" for a, b in pairs])).alias("coef"))


def _solve_udf(pairs: list[tuple[int, int]], m: int):
    from pyspark.sql.functions import pandas_udf

    def solve(s: pd.DataFrame) -> pd.Series:
        out = []
        for row in s.itertuples(index=False):
            g = np.zeros((m, m))
            for (a, b), v in zip(pairs, row, strict=True):
                g[a, b] = g[b, a] = v
            left, right = g[:-1, :-1], g[:-1, -1]
            out.append(np.linalg.solve(left, right).tolist() if np.linalg.matrix_rank(left) == m - 1 else None)
        return pd.Series(out)

    return pandas_udf(solve, "array<double>")


def pinv_fit(cells: DataFrame, b: DataFrame, rtol: float = GRAM_FLOOR) -> DataFrame:
    """Coefficients ``j, v`` of the least-norm fit of ``b(i, v)``: ``V s^-1 U^T b`` over values above ``rtol`` times the largest."""
    found = _decomposed(_sectors(cells, None))
    kept = found.crossJoin(F.broadcast(found.agg(F.max("s").alias("_top")))).where(F.col("s") > rtol * F.col("_top"))  # one row
    products = contract(cells.select("i", "j", "v"), b.select("i", "v"), ["i"], ["j"])
    along = kept.join(products.select("j", F.col("v").alias("_b")), "j").groupBy("pos").agg((F.sum(F.col("v") * F.col("_b")) / F.pow(F.first("s"), 2)).alias("_c"))
    return kept.join(along, "pos").groupBy("j").agg(F.sum(F.col("v") * F.col("_c")).alias("v"))


def expm_apply(edges: DataFrame, x: DataFrame, tau: float, terms: int) -> DataFrame:
    """``exp(tau M) x`` for ``M`` as edges ``(i, j, v)`` and ``x`` as ``(i, v)``, by Taylor series.

    ``tau`` is divided into steps in which the largest row sum of ``|tau M|`` is at most 1, each by ``terms`` terms;
    so a step's relative error is under ``e / (terms + 1)!`` in the maximum norm. With several steps, each one's
    result is checkpointed. Sums the rows at once.
    """
    rows = edges.groupBy("i").agg(F.sum(F.abs("v")).alias("v")).agg(F.max("v")).head()[0] or 0.0
    steps = max(1, int(np.ceil(abs(tau) * rows - 1e-9)))
    total = x.select("i", "v")
    for _ in range(steps):
        term = total
        for k in range(1, terms + 1):
            term = scale(contract(edges.select("i", "j", "v"), term.withColumnRenamed("i", "j"), ["j"], ["i"]), tau / steps / k)
            total = add(total, term, ["i"])
        total = total.checkpoint() if steps > 1 else total
    return total


def transitions(events: DataFrame, entity: str, state: str, order: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """``i, j, n, v``: counts of moves from one state to the next of an entity, and their share of the row's moves;
    for each group ``by``, of which an entity has one."""
    before = F.lag(state).over(Window.partitionBy(*by, entity).orderBy(*order))
    counts = events.select(*by, before.alias("i"), F.col(state).alias("j")).where(F.col("i").isNotNull()).groupBy(*by, "i", "j").agg(F.count("*").alias("n"))
    total = counts.groupBy(*by, "i").agg(F.sum("n").alias("_n"))
    return counts.join(total, [*by, "i"]).select(*by, "i", "j", "n", (F.col("n") / F.col("_n")).alias("v"))


def transition_spectrum(moves: DataFrame, n: int) -> DataFrame:
    """``pos, re, im``: the n leading eigenvalues of moves ``(i, j, v)``, over the first, by magnitude; imaginary
    parts are 0 if their norm is under 1e-6. States are the bound: more than ``SMALL_SIDE`` raise. No moves, no values.
    """
    states = moves.select(F.col("i").alias("state")).union(moves.select("j")).distinct()
    if states.limit(SMALL_SIDE + 1).count() > SMALL_SIDE:
        raise ValueError(f"over {SMALL_SIDE} states")
    # States of any type by number: few enough to be ordered in one task.
    named = states.withColumn("_id", F.row_number().over(Window.orderBy("state")).cast("bigint") - 1)
    cells = moves.join(named.toDF("i", "_i"), "i").join(named.toDF("j", "_j"), "j").select(F.lit(0).alias("_g"), F.col("_i").alias("i"), F.col("_j").alias("j"), "v")
    found = eig_by_group(cells, "_g").where(F.col("pos") < n).select("pos", "v.re", "v.im").checkpoint()
    first = found.where("pos = 0").select(F.col("re").alias("_re"), F.col("im").alias("_im"))
    size = F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im")
    re, im = (F.col("re") * F.col("_re") + F.col("im") * F.col("_im")) / size, (F.col("im") * F.col("_re") - F.col("re") * F.col("_im")) / size
    out = found.crossJoin(F.broadcast(first)).select("pos", re.alias("re"), im.alias("im"))  # one row
    norm = F.sqrt(F.sum(F.col("im") * F.col("im")).over(Window.partitionBy()))
    return out.withColumn("im", F.when(norm < 1e-6, 0.0).otherwise(F.col("im")))


def mixing_length(spectrum: DataFrame, period: float = 1.0) -> DataFrame:
    """``-period / ln|second value|`` of spectra ``(pos, re, im)``; nothing where there is no second value."""
    return spectrum.where("pos = 1").select((F.lit(-period) / F.ln(F.hypot("re", "im"))).alias("length"))


def _cross_pairs(table: pd.DataFrame) -> pd.DataFrame:
    """Singular vectors of one sector's cross matrix ``a, b, v``, as ``side, pos, s, i, v``."""
    left, right = np.unique(table["a"]), np.unique(table["b"])
    if max(len(left), len(right)) > SMALL_SIDE:
        raise ValueError(f"features over {SMALL_SIDE} in sector {table['sector'].iloc[0]}")
    m = np.zeros((len(left), len(right)))
    m[np.searchsorted(left, table["a"]), np.searchsorted(right, table["b"])] = table["v"]
    u, s, w = np.linalg.svd(m, full_matrices=False)
    n = int((s > 0).sum())
    out = []
    for side, index, x in (("left", left, u[:, :n]), ("right", right, w[:n].T)):
        out.append(pd.DataFrame({"side": side, "pos": np.tile(np.arange(n), len(index)), "s": np.tile(s[:n], len(index)), "i": np.repeat(index, n), "v": x.ravel()}))
    out = pd.concat(out)
    out.insert(0, "sector", table["sector"].iloc[0])
    return out


def two_sided_projectors(r: DataFrame, rt: DataFrame, k: int, dims: DataFrame | None = None, **cut) -> tuple[DataFrame, DataFrame]:
    """``P`` and ``Pt``, cells of rows i by directions j, from the SVD ``U s W^T`` of ``r^T rt``, sector by sector.

    r, rt: features ``(i, j, v)`` of the same rows i, with a column ``sector`` in both or in neither. ``P = rt W s^-1/2`` and
    ``Pt = r U s^-1/2``, so ``P^T Pt`` is the identity on the kept directions of each sector. What is kept are the k largest
    values over all sectors, each counted as often as ``dims`` (``sector, dim``; else 1) says, ties kept together: see
    ``cut_multiplets`` for ``cut``. Sectors that only one side has are left out. Each sector's small matrix is solved in a
    task; nothing of it reaches the driver. The pairs are checkpointed.
    """
    both = "sector" in r.columns and "sector" in rt.columns
    if both:
        r, rt = shared_sectors(r, rt)
    one, two = (x.select(F.col("sector") if both else F.lit(0).alias("sector"), "i", "j", "v") for x in (r, rt))
    cross = contract(one.withColumnRenamed("j", "a").withColumnRenamed("sector", "_s"), two.withColumnRenamed("j", "b").withColumnRenamed("sector", "_s"), ["_s", "i"], ["_s", "a", "b"]).withColumnRenamed("_s", "sector")
    kind = one.schema["sector"].dataType.simpleString()
    found = cross.groupBy("sector").applyInPandas(_cross_pairs, f"sector {kind}, side string, pos bigint, s double, i bigint, v double").checkpoint()
    weights = found.groupBy("sector", "pos").agg(F.first("s").alias("v"))
    weights = weights.join(dims, "sector") if dims is not None else weights.withColumn("dim", F.lit(1))
    kept = found.join(cut_multiplets(weights.select("sector", "pos", "dim", "v"), k, **cut).select("sector", "pos"), ["sector", "pos"], "left_semi").checkpoint()

    def onto(x: DataFrame, side: str) -> DataFrame:
        small = kept.where(F.col("side") == side).select("sector", "i", F.col("pos").alias("j"), (F.col("v") / F.sqrt("s")).alias("v"))
        out = product(x, small)
        return out if both else out.drop("sector")

    return onto(two, "right"), onto(one, "left")
