"""Sparse matrices in blocks of bounded cells, and their products with packed columns.

A packed table has a row for each part of a sector's indices, ``sector, part, idx, x``: the indices, ascending, as 64-bit
integers, and their numbers as doubles, a line of columns for each index. A block holds the cells between a part of the
rows and a part of the columns. So a product meets a block with one part, and what is shuffled are blocks and
parts, a row for thousands of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .lineage import cut, written

#: Cells of a block, about and at most; indices of a part, at least and at most.
CELLS, MOST = 1 << 18, 1 << 19
ROWS = 1 << 14, 1 << 18
#: Bytes of sums that a task holds before it passes them on.
HELD = 32 << 20


def matrix(raw: bytes | None, rows: int) -> np.ndarray:
    return np.frombuffer(raw or b"", np.float64).reshape(rows, -1) if rows else np.zeros((0, 0))


def binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.float64).tobytes()


def kind_of(df: DataFrame) -> tuple[str, pa.DataType]:
    """The type of the column ``sector``, by its names in Spark and in Arrow."""
    own = df.schema["sector"].dataType
    return own.simpleString(), to_arrow_type(own)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """A row at a time, its indices as an array."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            if row.get("idx") is not None:
                row["idx"] = np.frombuffer(row["idx"], np.int64)
            yield row


def one_row(kind: pa.DataType, **columns) -> pa.RecordBatch:
    """A batch of one row; ``sector`` is of the kind, whole numbers are 64-bit ones, arrays go as their bytes."""
    raw = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in columns.items()}
    return pa.RecordBatch.from_pydict({k: pa.array([v], kind if k == "sector" else pa.binary() if isinstance(v, bytes) else None) for k, v in raw.items()})


def random_lines(idx: np.ndarray, columns: int, seed: int) -> np.ndarray:
    """Numbers in [-1, 1) by index and column, the same in every run."""
    x = idx.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(columns, dtype=np.uint64) + np.uint64(1009 * seed + 1)) * np.uint64(0xD1B54A32D192ED03)
    for _ in range(2):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(11)).astype(np.float64) / 2.0**52 - 1.0


def added(pieces: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of packed pieces over all indices that any has."""
    if len(pieces) == 1:
        return pieces[0]
    idx = np.unique(np.concatenate([i for i, _ in pieces]))
    out = np.zeros((len(idx), max(x.shape[1] for _, x in pieces)))
    for i, x in pieces:
        out[np.searchsorted(idx, i), : x.shape[1]] += x
    return idx, out


def in_parts(df: DataFrame, tasks: int, *order: str) -> DataFrame:
    """Rows of a part together, in order, dealt to so many tasks whatever is merged at run time by the size of what is shuffled."""
    return df.repartition(tasks, "sector", "part").sortWithinPartitions("sector", "part", *order)


def packed_index(index: DataFrame, tasks: int) -> DataFrame:
    """``sector, part, idx`` of distinct rows ``sector, part, i``."""
    kind, arrow = kind_of(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for own, part, (i,) in _runs(batch, ("part",), ("i",)):
                if key is not None and key != (own, *part):
                    yield one_row(arrow, sector=key[0], part=key[1], idx=np.concatenate(held))
                    held = []
                key = (own, *part)
                held.append(i)
        if key is not None:
            yield one_row(arrow, sector=key[0], part=key[1], idx=np.concatenate(held))

    return in_parts(index, tasks, "i").mapInArrow(run, f"sector {kind}, part bigint, idx binary")


def packed_cells(cells: DataFrame, tasks: int) -> DataFrame:
    """``sector, part, idx, x`` of rows ``sector, part, i, k, v``; a part may be in several pieces."""
    kind, arrow = kind_of(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, (part,), (i, k, v) in _runs(batch, ("part",), ("i", "k", "v")):
                idx, at = np.unique(i, return_inverse=True)
                x = np.zeros((len(idx), int(k.max()) + 1))
                np.add.at(x, (at, k), v)
                yield one_row(arrow, sector=own, part=part, idx=idx, x=binary(x))

    return in_parts(cells, tasks).mapInArrow(run, f"sector {kind}, part bigint, idx binary, x binary")


def _runs(batch: pa.RecordBatch, keys: tuple[str, ...], values: tuple[str, ...]) -> Iterator[tuple]:
    """Stretches of a batch with one sector and keys: these, and the columns' arrays."""
    if not batch.num_rows:
        return
    sector = batch.column("sector")
    same = [sector.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False), *[batch.column(k).to_numpy() for k in keys]]
    change = np.any([x[1:] != x[:-1] for x in same], axis=0)
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    columns = [batch.column(c).to_numpy() for c in values]
    for a, b in zip(edges, edges[1:], strict=False):
        yield sector[a].as_py(), tuple(int(x[a]) for x in same[1:]), [c[a:b] for c in columns]


def summed(pieces: DataFrame, tasks: int, extra: Callable[[np.ndarray], dict] | None = None, fields: str = "") -> DataFrame:
    """One row for each part, the sum of its pieces; ``extra`` makes further columns, ``fields``, of its numbers."""
    kind, arrow = kind_of(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total, held = None, None, []

        def told() -> pa.RecordBatch:
            idx, x = added(held)
            return one_row(arrow, sector=key[0], part=key[1], idx=idx, x=binary(x), **(extra(x) if extra else {}))

        for row in rows_of(batches):
            if key is not None and key != (row["sector"], row["part"]):
                yield told()
                held = []
            key = (row["sector"], row["part"])
            held.append((row["idx"], matrix(row["x"], len(row["idx"]))))
            if sum(x.nbytes for _, x in held) > HELD:
                held = [added(held)]
        if key is not None:
            yield told()

    return in_parts(pieces, tasks).mapInArrow(run, f"sector {kind}, part bigint, idx binary, x binary{fields}")


def unpacked(packed: DataFrame, small: DataFrame) -> DataFrame:
    """Cells ``sector, i, j, v`` of packed columns times small matrices of their sectors, ``sector, m, names``: a matrix and
    the indices j of its columns. Exact zeros are left out."""
    kind, arrow = kind_of(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            names = np.array(row["names"], np.int64)
            x = matrix(row["x"], len(row["idx"]))
            out = x @ matrix(row["m"], x.shape[1])
            a, b = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array([row["sector"]] * len(a), arrow), pa.array(row["idx"][a]), pa.array(names[b]), pa.array(out[a, b])], ["sector", "i", "j", "v"])

    met = packed.select("sector", "idx", "x").join(small.select("sector", "m", "names"), "sector")
    return met.mapInArrow(run, f"sector {kind}, i bigint, j bigint, v double")


def reindexed(packed: DataFrame, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The same numbers under other indices, ascending too: their lines are as many as these."""
    kind, arrow = kind_of(packed)
    fields = ", ".join(f"{c} {t}" for c, t in packed.dtypes if c != "sector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield one_row(arrow, **(row | {"idx": of(row["idx"])}))

    return packed.mapInArrow(run, f"sector {kind}, {fields}")


class Blocks:
    """Cells ``sector, i, j, v`` in blocks, written once; :meth:`times` and its :meth:`flipped` form read them.

    Sectors are dealt to parts of rows and of columns so that a block has about CELLS cells and a part ``rows`` indices. Where one
    leg holds much of a sector its blocks are split by cells. Counts at once.
    """

    def __init__(self, cells: DataFrame, rows: tuple[int, int] = ROWS):
        self.kind, self.arrow = kind_of(cells)
        sides = cells.groupBy("sector").agg(F.count("*").alias("n"), F.approx_count_distinct("i").alias("r"), F.approx_count_distinct("j").alias("c"), F.sum(F.col("v") * F.col("v")).alias("energy"))
        side = F.least(F.greatest(F.sqrt(F.col("r") * 1.0 * F.col("c") * CELLS / F.col("n")), F.lit(float(rows[0]))), F.lit(float(rows[1])))
        grid = [F.greatest(F.ceil(F.col(x) / side), F.lit(1)).cast("bigint").alias(name) for x, name in (("r", "_p"), ("c", "_q"))]
        self.grid = cut(sides.select("sector", "n", "energy", *grid))
        tasks, p, q = self.grid.agg(F.sum(F.ceil(F.col("n") / CELLS)), F.sum("_p"), F.sum("_q")).head()
        self.tasks, self.names = (p or 1, q or 1), ("_p", "_q")
        placed = [F.pmod(F.xxhash64(x), n).alias(name) for x, n, name in (("i", "_p", "row"), ("j", "_q", "col"))]
        dealt = cells.join(self.grid, "sector").select("sector", *placed, "i", "j", F.col("v").cast("double").alias("v"))
        # By ranges of cells, so that no leg is one task; by one number, which sorts faster than its three.
        dealt = dealt.withColumn("_at", F.xxhash64("sector", "row", "col")).repartitionByRange(int(tasks or 1), "_at", "i", "j").sortWithinPartitions("_at").drop("_at")
        arrow = self.arrow

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, count = None, [], 0

            def block() -> pa.RecordBatch:
                i, j, v = (np.concatenate(x) for x in zip(*held, strict=True))
                (ri, a), (ci, b) = (np.unique(x, return_inverse=True) for x in (i, j))
                return one_row(arrow, sector=key[0], row=key[1], col=key[2], ri=ri, ci=ci, a=a.astype(np.int32), b=b.astype(np.int32), v=v)

            for batch in batches:
                for own, places, columns in _runs(batch, ("row", "col"), ("i", "j", "v")):
                    if held and (key != (own, *places) or count >= MOST):
                        yield block()
                        held, count = [], 0
                    key = (own, *places)
                    held.append(columns)
                    count += len(columns[0])
            if held:
                yield block()

        made = dealt.mapInArrow(run, f"sector {self.kind}, row bigint, col bigint, ri binary, ci binary, a binary, b binary, v binary")
        self.table = written(made, large=True)[0]

    def flipped(self) -> Blocks:
        """The transpose."""
        out = object.__new__(Blocks)
        out.kind, out.arrow, out.grid, out.tasks, out.names = self.kind, self.arrow, self.grid, self.tasks[::-1], self.names[::-1]
        out.table = self.table.select("sector", F.col("col").alias("row"), F.col("row").alias("col"), F.col("ci").alias("ri"), F.col("ri").alias("ci"), F.col("b").alias("a"), F.col("a").alias("b"), "v")
        return out

    def index(self) -> DataFrame:
        """``sector, part, idx``: parts of the columns."""
        pieces = self.table.select("sector", F.col("col").alias("part"), F.col("ci").alias("idx"), F.lit(b"").alias("x"))
        return summed(pieces, self.tasks[1]).drop("x")

    def random(self, columns: int, seed: int) -> DataFrame:
        """Packed columns of numbers in [-1, 1) by the columns' indices, the same in every run."""
        arrow = self.arrow

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                yield one_row(arrow, **row, x=binary(random_lines(row["idx"], columns, seed)))

        return self.index().mapInArrow(run, f"sector {self.kind}, part bigint, idx binary, x binary")

    def packed(self, cells: DataFrame) -> DataFrame:
        """Pieces of columns ``sector, i, k, v`` on the columns' indices, in their parts."""
        placed = cells.join(self.grid.select("sector", self.names[1]), "sector").withColumn("part", F.pmod(F.xxhash64("i"), self.names[1]))
        return packed_cells(placed.select("sector", "part", "i", "k", "v"), self.tasks[1])

    def image(self, cells: DataFrame) -> DataFrame:
        """``sector, i, k, v``: the products with columns ``sector, i, k, v``; zeros are left out."""
        arrow = self.arrow

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                x = matrix(row["x"], len(row["idx"]))
                a, k = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([row["sector"]] * len(a), arrow), pa.array(row["idx"][a]), pa.array(k, pa.int64()), pa.array(x[a, k])], ["sector", "i", "k", "v"])

        lines = summed(self.times(summed(self.packed(cells), self.tasks[1])), self.tasks[0])
        return lines.mapInArrow(run, f"sector {self.kind}, i bigint, k bigint, v double")

    def energy(self) -> DataFrame:
        """``sector, energy``: the sum of all cells' squares."""
        return self.grid.select("sector", "energy")

    def times(self, x: DataFrame) -> DataFrame:
        """Pieces ``sector, part, idx, x`` of the products with packed columns, whose parts are those of :meth:`index`; a part's are
        to be added (see :func:`summed`)."""
        arrow = self.arrow

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict = {}
            size = 0

            def passed() -> Iterator[pa.RecordBatch]:
                for key, pieces in held.items():
                    idx, y = added(pieces)
                    yield one_row(arrow, sector=key[0], part=key[1], idx=idx, x=binary(y))
                held.clear()

            for row in rows_of(batches):
                ri, ci = (np.frombuffer(row[c], np.int64) for c in ("ri", "ci"))
                a, b = (np.frombuffer(row[c], np.int32) for c in ("a", "b"))
                v, lines = np.frombuffer(row["v"], np.float64), matrix(row["x"], len(row["idx"]))
                if not lines.size:
                    continue
                at = np.minimum(np.searchsorted(row["idx"], ci), len(lines) - 1)
                own = np.where((row["idx"][at] == ci)[:, None], lines[at], 0.0).T.copy()
                y = np.empty((len(ri), len(own)))
                for k, column in enumerate(own):
                    y[:, k] = np.bincount(a, v * column[b], minlength=len(ri))
                held.setdefault((row["sector"], row["row"]), []).append((ri, y))
                size += y.nbytes
                if size > HELD:
                    held = {k: [added(p)] for k, p in held.items()}
                    size = sum(p[0][1].nbytes for p in held.values())
                    if size > HELD // 2:
                        yield from passed()
                        size = 0
            yield from passed()

        met = self.table.join(x.select("sector", F.col("part").alias("col"), "idx", "x"), ["sector", "col"])
        return met.select("sector", "row", "ri", "ci", "a", "b", "v", "idx", "x").mapInArrow(run, f"sector {self.kind}, part bigint, idx binary, x binary")
