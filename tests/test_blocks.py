"""Products by blocks, packed columns and bases in bounded parts, against dense arrays."""

import glob
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from sectorframe.operators import blocks, krylov, linalg, orthogonal
from sectorframe.operators.blocks import Blocks, reindexed, summed
from sectorframe.operators.lineage import written


def _cells(spark, parts):
    rows = []
    for sector, m in parts.items():
        i, j = np.nonzero(m)
        rows.append(pd.DataFrame({"sector": sector, "i": i, "j": j, "v": m[i, j]}))
    return spark.createDataFrame(pd.concat(rows), "sector string, i bigint, j bigint, v double")


def _sparse(rng, rows, cols, share=0.3):
    m = rng.normal(size=(rows, cols)) * (rng.random((rows, cols)) < share)
    m[:, 0] = 1.0  # a column that every row has
    return m


def _dense(packed, sector, rows):
    out = {}
    for r in packed:
        if r.sector == sector:
            out |= dict(zip(np.frombuffer(r.idx, np.int64).tolist(), np.frombuffer(r.x).reshape(len(r.idx) // 8, -1), strict=True))
    return np.array([out[i] for i in range(rows)])


def _numbers(index):
    """Two columns, of the sine of the index and of itself."""

    def run(batches):
        for row in blocks.rows_of(batches):
            yield blocks.one_row(pa.string(), **row, x=blocks.binary(np.c_[np.sin(row["idx"]), row["idx"]]))

    return index.mapInArrow(run, "sector string, part bigint, idx binary, x binary")


def test_products_by_blocks(spark, monkeypatch):
    """Two sectors of many blocks, both ways; each part comes once, with all its indices."""
    monkeypatch.setattr(blocks, "CELLS", 64)
    rng = np.random.default_rng(31)
    parts = {"a": _sparse(rng, 90, 50), "b": _sparse(rng, 7, 120, 1.0)}
    own = Blocks(_cells(spark, parts), rows=(8, 16))
    assert own.table.count() > 20 and own.table.select("sector", "row", "col").distinct().count() > 10
    for b, turned in ((own, False), (own.flipped(), True)):
        x = _numbers(b.index()).cache()
        assert x.select("sector", "part").distinct().count() == x.count()
        got = summed(b.times(x), b.flipped().tasks[1]).collect()
        for k, m in parts.items():
            m = m.T if turned else m
            i = np.arange(m.shape[1])
            assert np.allclose(_dense(got, k, len(m)), m @ np.c_[np.sin(i), i], rtol=0, atol=1e-12 * np.abs(m).sum())


def test_a_leg_with_most_cells_is_split(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", 500)
    monkeypatch.setattr(blocks, "MOST", 500)
    m = np.zeros((6000, 3))
    m[:, 1] = 1.0
    own = Blocks(_cells(spark, {"a": m}), rows=(1 << 14, 1 << 18))
    sizes = [len(r.v) // 8 for r in own.table.select("v").collect()]
    assert sum(sizes) == 6000 and len(sizes) > 6


def test_eigenpairs_of_packed_columns(spark, monkeypatch):
    """``M^T M`` on two copies of its columns, by blocks: each value is there twice."""
    monkeypatch.setattr(blocks, "CELLS", 256)
    rng = np.random.default_rng(5)
    parts = {"a": _sparse(rng, 60, 40), "b": _sparse(rng, 20, 70)}
    own = Blocks(_cells(spark, parts), rows=(8, 16))

    def copies(i):
        return np.repeat(2 * i, 2) + np.tile([0, 1], len(i))

    def doubled(x):
        inner = own.times(reindexed(x, lambda i: i[::2] // 2))
        return reindexed(own.flipped().times(summed(inner, 4)), copies)

    values, vectors = krylov.eigenpairs(doubled, reindexed(own.index(), copies), 2, basis=16)
    values, vectors = values.toPandas(), vectors.toPandas()
    for k, m in parts.items():
        top = np.linalg.norm(m, 2) ** 2
        assert np.allclose(values[values["sector"] == k]["re"], [top, top], rtol=1e-9)
        x, at = np.zeros((2 * m.shape[1], 2)), vectors[vectors["sector"] == k]
        x[at["i"], at["k"]] = at["re"]
        assert np.allclose(x.T @ x, np.eye(2), atol=1e-9)
        assert np.allclose(m.T @ (m @ x[::2]), top * x[::2], atol=1e-7 * top)


def test_rows_of_a_basis_are_bounded_by_bytes(spark, monkeypatch):
    """However many columns a basis has: its parts have less rows then."""
    monkeypatch.setattr(krylov, "SIZE", 1 << 16)
    kept = []
    monkeypatch.setattr(krylov, "drop", lambda spark, path: kept.append(path))
    diagonal = spark.createDataFrame(pd.DataFrame({"sector": 0, "i": np.arange(3000), "d": np.r_[9.0, 8, 7, np.linspace(0, 3, 2997)]}), "sector int, i bigint, d double")
    values, _ = krylov.eigenpairs(lambda x: x.join(diagonal, ["sector", "i"]).select("sector", "i", "k", (F.col("v") * F.col("d")).alias("v")), diagonal, 3, basis=15)
    assert np.allclose(sorted(values.toPandas()["re"]), [7, 8, 9])
    sizes = [r[0] for p in kept for r in spark.read.parquet(p).select(F.length("q") + F.length("y") + F.length("z")).collect()]
    assert len(sizes) >= 11 * len(kept) and max(sizes) < 2 * 256 * 8 * 2 * 25


def test_large_rows_make_small_groups(spark):
    """A reader holds a group of rows; a writer that looks at its size after a hundred rows makes one of all these."""
    rows = spark.range(40, numPartitions=1).select("id", F.expr("array_join(transform(sequence(1, 16384), x -> sha2(concat(id, '-', x), 256)), '')").cast("binary").alias("raw"))
    table, path = written(rows, large=True)
    groups = [g for f in glob.glob(os.path.join(path.removeprefix("file:"), "*.parquet")) for m in [pq.ParquetFile(f).metadata] for g in [m.row_group(k) for k in range(m.num_row_groups)]]
    assert max(g.total_byte_size for g in groups) < 20 << 20 and sum(g.num_rows for g in groups) == 40 == table.count()


def test_factors_of_packed_columns(spark):
    """Any rank and condition, parts with fewer rows than columns, a sector of zeros: ``Q R`` is the matrix."""
    rng = np.random.default_rng(11)
    turn = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    parts = {"bad": rng.normal(size=(60, 8)) @ (turn * 10.0 ** -np.arange(0, 16, 2)), "few": np.repeat(rng.normal(size=(40, 3)), 2, 1) * [1, 1, 3, 1, 1, 1], "none": np.zeros((5, 4))}
    rows = [(k, p, np.arange(p, len(m), 9).tobytes(), m[p::9].tobytes()) for k, m in parts.items() for p in range(9) if p < len(m)]
    q, r = orthogonal.packed_qr(spark.createDataFrame(rows, "sector string, part bigint, idx binary, x binary").repartition(5), 4)
    factors, q = {x.sector: np.frombuffer(x.total).reshape(-1, x.w) for x in r.collect()}, q.collect()
    for k, m in parts.items():
        own = _dense(q, k, len(m))
        assert own.shape[1] == {"bad": 8, "few": 3, "none": 0}[k]
        assert np.allclose(own.T @ own, np.eye(own.shape[1]), atol=1e-13)
        assert np.allclose(own @ factors[k], m, rtol=0, atol=1e-13 * np.abs(m).max())


def test_randomized_svd_and_what_it_leaves_out_by_blocks(spark, monkeypatch):
    """Cells of two sectors in many blocks: the largest values, and the energy of the rest."""
    monkeypatch.setattr(blocks, "CELLS", 300)
    rng = np.random.default_rng(12)
    parts = {k: (rng.normal(size=(70, 40)) * 0.5 ** np.arange(40)) @ rng.normal(size=(40, 150)) * size for k, size in (("a", 1.0), ("b", 0.9))}
    own = Blocks(_cells(spark, parts), rows=(8, 32))
    u, s, v = linalg.randomized_svd(own, 3, "sector")
    exact = {k: np.linalg.svd(m, compute_uv=False) for k, m in parts.items()}
    top = sorted(((x, k) for k, f in exact.items() for x in f), reverse=True)[:3]
    assert np.allclose(sorted((r.v for r in s.collect()), reverse=True), [x for x, _ in top], rtol=1e-9)
    lost = {r.sector: r.lost for r in linalg.left_out(own, u, s, v, "sector").collect()}
    for k, f in exact.items():
        assert np.isclose(lost[k], (f**2).sum() - sum(x * x for x, name in top if name == k), rtol=1e-9)
