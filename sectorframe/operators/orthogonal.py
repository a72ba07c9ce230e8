"""Orthogonal factors of tall matrices of any rank and condition, sector by sector.

Rows are factored where they lie: each task keeps a triangular factor of the rows it has seen, and
factors meet up a tree until a sector has one. What a task holds is one stack of factors of the
column side, whose size is checked first. The tree's factor tells the rank, with column pivoting,
and is as good as one of all rows at once, so small singular values survive in it.

All take ``sector, i, j, v``; ``sector`` is of any type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import binary, kind_of, matrix, one_row, rows_of, summed
from .lineage import cut, written

#: Columns of a sector, at most; more raises.
COLUMNS = 2048
#: Factors that meet in one node of the tree, and bytes of factors that a task holds before it passes them on.
FAN, HELD = 16, 64 << 20
#: Cells of a part of a sector that one task multiplies, about.
PART = 1 << 20
_EPS = float(np.finfo(float).eps)


def _packed(cells: DataFrame, *keys: str) -> DataFrame:
    """One row for each row of a sector, with its cells as a list."""
    return cells.groupBy("sector", *keys, "i").agg(F.collect_list(F.struct("j", F.col("v").cast("double").alias("v"))).alias("row"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows' numbers, columns and values of lists of cells."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
    j, v = (pc.struct_field(column.flatten(), k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return row, j, v


def _as_lists(x: np.ndarray, index: np.ndarray) -> pa.Array:
    """The same lists of a dense matrix."""
    rows, cols = np.nonzero(x)
    edges = np.searchsorted(rows, np.arange(len(x) + 1))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(index[cols], pa.int64()), pa.array(x[rows, cols], pa.float64())], ["j", "v"]))


def _dense(row: np.ndarray, j: np.ndarray, v: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of some rows, and its columns' indices."""
    index, place = np.unique(j, return_inverse=True)
    if len(index) > COLUMNS:
        raise ValueError(f"a sector has over {COLUMNS} columns")
    x = np.zeros((rows, len(index)))
    np.add.at(x, (row, place), v)
    return x, index


def _stacked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One matrix over another, over the columns that either has, as its triangular factor where it is taller than wide."""
    index = np.union1d(a[1], b[1])
    if len(index) > COLUMNS:
        raise ValueError(f"a sector has over {COLUMNS} columns")
    x = np.zeros((len(a[0]) + len(b[0]), len(index)))
    x[: len(a[0]), np.searchsorted(index, a[1])] = a[0]
    x[len(a[0]) :, np.searchsorted(index, b[1])] = b[0]
    return (np.linalg.qr(x, mode="r") if len(x) > len(index) else x), index


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triangular factors of what a task reads, ``sector, node, row``."""
    held: dict = {}
    node = TaskContext.get().partitionId()

    def passed() -> Iterator[pa.RecordBatch]:
        for key, (x, index) in held.items():
            lists = _as_lists(x, index)
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(x), kind), pa.array(np.full(len(x), node), pa.int64()), lists], ["sector", "node", "row"])
        held.clear()

    for batch in batches:
        kind = batch.schema.field("sector").type
        row, j, v = _lists(batch.column("row"))
        codes = batch.column("sector").dictionary_encode()
        names, group = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(group[row], kind="stable")
        row, j, v = row[order], j[order], v[order]
        edges = np.searchsorted(group[row], np.arange(len(names) + 1))
        for g, key in enumerate(names):
            own = slice(edges[g], edges[g + 1])
            lines, line = np.unique(row[own], return_inverse=True)
            new = _dense(line, j[own], v[own], len(lines))
            held[key] = _stacked(held.get(key, (np.zeros((0, 0)), np.zeros(0, np.int64))), new)
        if sum(x.nbytes for x, _ in held.values()) > HELD:
            yield from passed()
    yield from passed()


def _node(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The factor of some factors' rows, some at a time."""
    out = (np.zeros((0, 0)), np.zeros(0, np.int64))
    step = 2 * COLUMNS
    for k in range(0, len(table), step):
        row, j, v = _lists(table["row"].slice(k, step))
        out = _stacked(out, _dense(row, j, v, min(step, len(table) - k)))
    return out


def tree(cells: DataFrame) -> DataFrame:
    """``sector, node, row``: rows of which each sector's matrix has the singular values of all its rows; at most FAN
    factors are left for a sector. Runs at once."""
    kind = cells.schema["sector"].dataType.simpleString()
    schema = f"sector {kind}, node bigint, row array<struct<j: bigint, v: double>>"
    rows = cut(_packed(cells).select("sector", "row").mapInArrow(_local, schema))
    width = (rows.agg(F.max("node")).head()[0] or 0) + 1

    def met(table: pa.Table) -> pa.Table:
        x, index = _node(table)
        first = table.slice(0, 1)
        return pa.table({"sector": pa.array(first["sector"].to_pylist() * len(x), table.schema.field("sector").type), "node": pa.array(first["node"].to_pylist() * len(x), pa.int64()), "row": _as_lists(x, index)})

    while width > FAN:
        rows = rows.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("sector", "node").applyInArrow(met, schema)
        rows = cut(rows)
        width = -(-width // FAN)
    return rows


def pivots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order in which Householder steps with column pivoting take columns, and the factor's diagonal."""
    x, n = x.copy(), x.shape[1]
    order, diagonal = np.arange(n), np.zeros(min(x.shape))
    for k in range(len(diagonal)):
        norms = np.einsum("ij,ij->j", x[k:, k:], x[k:, k:])
        p = k + int(norms.argmax())
        if p != k:
            x[:, [k, p]], order[[k, p]] = x[:, [p, k]], order[[p, k]]
        w = x[k:, k].copy()
        size = np.linalg.norm(w)
        diagonal[k] = size
        if size == 0:
            break
        w[0] += np.copysign(size, w[0])
        x[k:, k:] -= np.outer(w, (2 / (w @ w)) * (w @ x[k:, k:]))
    return order, diagonal


def independent(x: np.ndarray) -> np.ndarray:
    """Places of columns, ascending, that span all of them: the rank's number, by unit columns with pivoting."""
    norms = np.sqrt(np.einsum("ij,ij->j", x, x))
    scaled = x / np.where(norms > 0, norms, 1)
    order, diagonal = pivots(scaled)
    rank = int((diagonal > 16 * max(x.shape[1], 1) * _EPS).sum())
    return np.sort(order[:rank])


def _factored(table: pa.Table) -> pa.Table:
    """A sector's triangular factor: cells of the independent columns."""
    x, index = _node(table)
    own = independent(x)
    r = np.linalg.qr(x[:, own], mode="r")
    r = r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]
    i, j = np.nonzero(np.triu(r))
    sector = pa.array(table["sector"].slice(0, 1).to_pylist() * len(i), table.schema.field("sector").type)
    return pa.table({"sector": sector, "i": pa.array(index[own[i]], pa.int64()), "j": pa.array(index[own[j]], pa.int64()), "v": pa.array(r[i, j], pa.float64())})


def _square_of(cells: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, cols = np.unique(cells["i"].to_numpy()), np.unique(cells["j"].to_numpy())
    m = np.zeros((len(rows), len(cols)))
    m[np.searchsorted(rows, cells["i"].to_numpy()), np.searchsorted(cols, cells["j"].to_numpy())] = cells["v"].to_numpy()
    return m, rows, cols


def by_parts(cells: DataFrame, small: DataFrame, run: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``sector, i, j, v``: for parts of each sector's rows, dense over the small matrix's rows, what ``run(part, small)``
    makes of them; cells of one place are summed, and exact zeros left out. Sectors are dealt to parts by their cells, so that a
    large one is no single task; the small matrix ``sector, i, j, v`` goes once to each part. Counts at once: tasks are twice the
    parts, so that what one sorts is bounded by a few parts, whatever is merged at run time by the size of what is shuffled."""
    kind, rows_kind = (cells.schema[c].dataType.simpleString() for c in ("sector", "i"))
    parts = cut(cells.groupBy("sector").agg(F.ceil(F.count("*") / PART).cast("bigint").alias("parts")))
    tasks = 2 * (parts.agg(F.sum("parts")).head()[0] or 1)
    dealt = cells.select("sector", "i", "j", F.col("v").cast("double").alias("v")).join(parts, "sector").withColumn("part", F.pmod(F.xxhash64("i"), "parts"))
    each = small.join(parts.select("sector", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")), "sector")

    def one(own: pa.Table, other: pa.Table) -> pa.Table:
        if not len(own) or not len(other):
            return pa.table({"sector": pa.array([], own.schema.field("sector").type), "i": pa.array([], own.schema.field("i").type), "j": pa.array([], pa.int64()), "v": pa.array([], pa.float64())})
        m, rows, cols = _square_of(other)
        j, v = (own[c].to_numpy() for c in ("j", "v"))
        at = np.searchsorted(rows, j)
        known = (at < len(rows)) & (rows[np.minimum(at, len(rows) - 1)] == j)
        coded = own["i"].combine_chunks().dictionary_encode(null_encoding="encode")
        lines, line = coded.dictionary, coded.indices.to_numpy()
        x = np.zeros((len(lines), len(rows)))
        np.add.at(x, (line[known], at[known]), v[known])
        out = run(x, m)
        a, b = np.nonzero(out)
        sector = pa.array(own["sector"].slice(0, 1).to_pylist() * len(a), own.schema.field("sector").type)
        return pa.table({"sector": sector, "i": lines.take(pa.array(a)), "j": pa.array(cols[b], pa.int64()), "v": pa.array(out[a, b])})

    left, right = (x.select("sector", "part", "i", "j", "v").repartition(tasks, "sector", "part").groupBy("sector", "part") for x in (dealt, each))
    return left.cogroup(right).applyInArrow(one, f"sector {kind}, i {rows_kind}, j bigint, v double")


def product(cells: DataFrame, small: DataFrame) -> DataFrame:
    """Cells times small matrices of their sectors."""
    return by_parts(cells, small, lambda x, m: x @ m)


def _divided(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.linalg.solve(r.T, x.T).T


def tall_qr(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``Q`` with orthonormal columns and ``R``, cells ``sector, i, j, v``; see ``linalg.qr``. Runs at once."""
    kind = cells.schema["sector"].dataType.simpleString()
    schema = f"sector {kind}, i bigint, j bigint, v double"
    cells = cells.select("sector", "i", "j", F.col("v").cast("double").alias("v")).where("v <> 0")
    cells = cut(cells)
    q, total = cells, None
    for _ in range(2):  # rows over a factor of bad condition are orthonormal up to that; once more they are
        r = cut(tree(q).groupBy("sector").applyInArrow(_factored, schema))
        q = cut(by_parts(q, r, _divided))
        total = r if total is None else product(r, total)
    own = cut(total)
    # Columns that depend on others have their share of each direction.
    rest = cells.join(own.select("sector", F.col("i").alias("j")).distinct(), ["sector", "j"], "left_anti")
    if not rest.isEmpty():
        left = q.select("sector", F.col("i").alias("_r"), F.col("j").alias("i"), F.col("v").alias("_a"))
        right = rest.select("sector", F.col("i").alias("_r"), "j", F.col("v").alias("_b"))
        own = own.union(left.join(right, ["sector", "_r"]).groupBy("sector", "i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("v")))
    return q, own


def jacobi(r: np.ndarray, sweeps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``u, s, v`` of a matrix by one-sided rotations, values descending, exact zeros left out.

    Small values are right relative to themselves where the matrix is one of good condition with scaled columns.
    """
    order, _ = pivots(r)
    q, t = np.linalg.qr(r[:, order])
    x = np.ascontiguousarray(t.T)  # its columns become orthogonal
    n = x.shape[1]
    turn = np.eye(n)
    seats = np.arange(n + n % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(1, len(seats) - 1)):
            a, b = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            ok = (a < n) & (b < n)
            a, b = np.minimum(a, b)[ok], np.maximum(a, b)[ok]
            xa, xb = x[:, a], x[:, b]
            aa, bb, ab = (np.einsum("ij,ij->j", p, q_) for p, q_ in ((xa, xa), (xb, xb), (xa, xb)))
            size = np.sqrt(aa) * np.sqrt(bb)
            share = np.abs(ab) / np.where(size > 0, size, 1)
            worst = max(worst, float(share.max(initial=0)))
            go = (share > _EPS) & (size > 0)
            if go.any():
                a, b, aa, bb, ab = a[go], b[go], aa[go], bb[go], ab[go]
                zeta = (bb - aa) / (2 * ab)
                tan = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                cos = 1 / np.hypot(1, tan)
                sin = cos * tan
                for m in (x, turn):
                    ma, mb = m[:, a], m[:, b]
                    m[:, a], m[:, b] = cos * ma - sin * mb, sin * ma + cos * mb
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst <= 4 * np.sqrt(max(n, 1)) * _EPS:
            break
    s = np.sqrt(np.einsum("ij,ij->j", x, x))
    down = np.argsort(-s, kind="stable")
    down = down[s[down] > 0]
    v = np.zeros((r.shape[1], len(down)))
    v[order] = x[:, down] / s[down]
    return q @ turn[:, down], s[down], v


def _triple(table: pd.DataFrame) -> pd.DataFrame:
    """The factors of a sector's small matrix, as ``what, i, pos, v``."""
    rows, cols = np.unique(table["i"]), np.unique(table["j"])
    m = np.zeros((len(rows), len(cols)))
    m[np.searchsorted(rows, table["i"]), np.searchsorted(cols, table["j"])] = table["v"]
    u, s, v = jacobi(m)
    top = v[np.abs(v).argmax(0), np.arange(v.shape[1])] if v.size else np.zeros(0)
    sign = np.where(top < 0, -1.0, 1.0)
    out, k = [], np.arange(len(s))
    for what, index, x in (("u", rows, u * sign), ("v", cols, v * sign), ("s", np.zeros(1, np.int64), s[None, :])):
        out.append(pd.DataFrame({"what": what, "i": np.repeat(index, len(s)), "j": np.tile(k, len(index)), "v": x.ravel()}))
    out = pd.concat(out)
    out.insert(0, "sector", table["sector"].iloc[0])
    return out


def tall_svd(cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``U``, ``sector, pos, dim, v`` and ``V`` of every sector, values down to rounding; see ``linalg.accurate_svd``."""
    q, r = tall_qr(cells)
    kind = cells.schema["sector"].dataType.simpleString()
    found = r.groupBy("sector").applyInPandas(_triple, f"sector {kind}, what string, i bigint, j bigint, v double")
    found = cut(found)
    u = product(q, found.where("what = 'u'").drop("what"))
    s = found.where("what = 's'").select("sector", F.col("j").alias("pos"), F.lit(1).alias("dim"), "v")
    return u, s, found.where("what = 'v'").drop("what")


def _roots(rows: DataFrame) -> DataFrame:
    """``sector, own, r, total, w``: of each sector's parts' factors one: its independent columns ``own``, the triangular factor ``r``
    of these and ``total`` of all ``w`` columns. Tasks join what they read, then a sector's factors meet. Written."""
    kind, arrow = kind_of(rows)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for key, x in held.items():
                yield one_row(arrow, sector=key, r=binary(x), w=x.shape[1])
            held.clear()

        for row in rows_of(batches):
            x = np.frombuffer(row["r"], np.float64).reshape(-1, row["w"]) if row["w"] else np.zeros((0, 0))
            x = np.vstack([held[row["sector"]], x]) if row["sector"] in held else x
            held[row["sector"]] = np.linalg.qr(x, mode="r") if len(x) > x.shape[1] else x
            if sum(x.nbytes for x in held.values()) > HELD:
                yield from passed()
        yield from passed()

    def whole(table: pd.DataFrame) -> pd.DataFrame:
        w = int(table["w"].iloc[0])
        x = np.vstack([np.frombuffer(r, np.float64).reshape(-1, w) for r in table["r"]]) if w else np.zeros((0, 0))
        own = independent(x)
        q, r = np.linalg.qr(x[:, own])
        sign = np.where(np.diag(r) < 0, -1.0, 1.0)
        return pd.DataFrame([{"sector": table["sector"].iloc[0], "own": own.tolist(), "r": binary(r * sign[:, None]), "total": binary((q * sign).T @ x), "w": w}])

    each = rows.select("sector", "r", "w").mapInArrow(partial, f"sector {kind}, r binary, w bigint")
    return cut(each.groupBy("sector").applyInPandas(whole, f"sector {kind}, own array<bigint>, r binary, total binary, w bigint"))


def _factor(x: np.ndarray) -> dict:
    return {"r": binary(np.linalg.qr(x, mode="r")), "w": x.shape[1]}


def packed_qr(pieces: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """The same as :func:`tall_qr` for pieces of packed columns (see ``blocks``), which it adds: packed ``Q``, whose columns are
    numbered from 0, and ``sector, total, w``, the triangular factor. What is written has a row for each of ``tasks`` parts, with
    its own factor, so that the factors of all are found without reading the columns. Runs at once but the last division."""
    kind, arrow = kind_of(pieces)
    fields = f"sector {kind}, part bigint, idx binary, x binary"

    def divided(rows: DataFrame, small: DataFrame, factors: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                own, x = np.array(row["own"], np.int64), matrix(row["x"], len(row["idx"]))
                q = _divided(x[:, own], np.frombuffer(row["r"], np.float64).reshape(len(own), -1)) if len(own) else x[:, :0]
                yield one_row(arrow, sector=row["sector"], part=row["part"], idx=row["idx"], x=binary(q), **(_factor(q) if factors else {}))

        met = rows.select("sector", "part", "idx", "x").join(small.select("sector", "own", "r"), "sector")
        return met.mapInArrow(run, fields + (", r binary, w bigint" if factors else ""))

    rows = written(summed(pieces, tasks, _factor, ", r binary, w bigint"), large=True)[0]
    first = _roots(rows)
    rows = written(divided(rows, first, True), large=True)[0]  # orthonormal up to the factor's condition; once more it is
    second = _roots(rows)

    def times(table: pd.DataFrame) -> pd.DataFrame:
        row = table.iloc[0]
        one = np.frombuffer(row["total"], np.float64).reshape(-1, row["w"]) if row["w"] else np.zeros((0, 0))
        two = np.frombuffer(row["two"], np.float64).reshape(-1, len(one)) if len(one) else np.zeros((0, 0))
        return pd.DataFrame([{"sector": row["sector"], "total": binary(two @ one), "w": row["w"]}])

    both = first.select("sector", "total", "w").join(second.select("sector", F.col("total").alias("two")), "sector")
    return divided(rows, second, False), both.groupBy("sector").applyInPandas(times, f"sector {kind}, total binary, w bigint")


def packed_svd(pieces: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Packed ``Q``, and ``sector, what, i, j, v`` of the factors of what it is to be multiplied by: as :func:`tall_svd`, ``Q`` times ``u``
    are the left vectors, ``s`` the values and ``v`` the right vectors. The factors are written."""
    q, r = packed_qr(pieces, tasks)
    kind = kind_of(pieces)[0]

    def triple(table: pd.DataFrame) -> pd.DataFrame:
        row = table.iloc[0]
        m = np.frombuffer(row["total"], np.float64).reshape(-1, row["w"]) if row["w"] else np.zeros((0, 0))
        i, j = (x.ravel() for x in np.indices(m.shape))
        return _triple(pd.DataFrame({"sector": [row["sector"]] * m.size, "i": i, "j": j, "v": m.ravel()})) if m.size else pd.DataFrame({"sector": [], "what": [], "i": [], "j": [], "v": []})

    return q, cut(r.groupBy("sector").applyInPandas(triple, f"sector {kind}, what string, i bigint, j bigint, v double"))
