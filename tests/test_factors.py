"""Factors, eigenpairs and systems by sector, against dense arrays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sectorframe.operators import linalg, orthogonal
from sectorframe.operators.joins import block_times
from sectorframe.operators.krylov import eigenpairs
from sectorframe.operators.solvers import solve


def _cells(spark, parts, kind="string"):
    rows = []
    for sector, m in parts.items():
        i, j = np.nonzero(m)
        rows.append(pd.DataFrame({"sector": sector, "i": i, "j": j, "v": np.asarray(m, float)[i, j]}))
    return spark.createDataFrame(pd.concat(rows), f"sector {kind}, i bigint, j bigint, v double")


def _dense(cells, sector, shape):
    out = np.zeros(shape)
    own = cells[cells["sector"] == sector]
    out[own["i"], own["j"]] = own["v"]
    return out


def _matrices():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    bad = rng.normal(size=(60, 8)) * 10.0 ** -np.linspace(0, 12, 8) @ turn
    low = rng.normal(size=(50, 3)) @ rng.normal(size=(3, 7))
    low[:, 2] = 0
    return {
        "tall": rng.normal(size=(300, 6)),
        "bad": bad,  # condition 1e12
        "low": low,  # rank 3, with a column of zeros
        "wide": rng.normal(size=(3, 9)),
        "graded": rng.normal(size=(40, 5)) * 10.0 ** -np.array([0, 3, 6, 9, 12]),
        "one": np.array([[-2.0]]),
    }


@pytest.mark.parametrize(("fan", "held"), [(16, 64 << 20), (2, 1000)])
def test_qr_of_any_rank_and_condition(spark, monkeypatch, fan, held):
    """The tree has several levels where few factors meet in a node, and tasks pass on what they hold."""
    monkeypatch.setattr(orthogonal, "FAN", fan)
    monkeypatch.setattr(orthogonal, "HELD", held)
    parts = _matrices()
    q, r = linalg.qr(_cells(spark, parts).repartition(7), "sector")
    ranks = {x.sector: x["rank"] for x in linalg.ranks(r).collect()}
    assert ranks == {"tall": 6, "bad": 8, "low": 3, "wide": 3, "graded": 5, "one": 1}
    q, r = q.toPandas(), r.toPandas()
    for name, m in parts.items():
        n = m.shape[1]
        own, upper = _dense(q, name, m.shape), _dense(r, name, (n, n))
        used = np.flatnonzero(np.abs(own).sum(0))
        assert len(used) == ranks[name]
        assert np.allclose(own[:, used].T @ own[:, used], np.eye(len(used)), atol=1e-13)
        assert np.allclose(own @ upper, m, rtol=0, atol=1e-13 * np.abs(m).max())
        assert np.allclose(upper[np.ix_(used, used)], np.triu(upper[np.ix_(used, used)]))


def test_small_singular_values(spark):
    parts = _matrices()
    u, s, v = linalg.accurate_svd(_cells(spark, parts).repartition(5), "sector")
    u, s, v = u.toPandas(), s.toPandas(), v.toPandas()
    for name, m in parts.items():
        own = s[s["sector"] == name].sort_values("pos")["v"].to_numpy()
        left, right = _dense(u, name, (len(m), len(own))), _dense(v, name, (m.shape[1], len(own)))
        assert np.allclose(left.T @ left, np.eye(len(own)), atol=1e-12) and np.allclose(right.T @ right, np.eye(len(own)), atol=1e-12)
        assert np.allclose(left * own @ right.T, m, rtol=0, atol=1e-12 * own[0])
        if name in ("graded", "bad"):  # 1e-12 of the largest, and right
            exact = np.linalg.svd(m, compute_uv=False)
            assert len(own) == len(exact) and own[-1] < 1e-11 * own[0] and np.allclose(own, exact, rtol=1e-4 if name == "graded" else 1e-2)


def test_rotations_are_right_for_each_value():
    d = 10.0 ** -np.arange(0.0, 40, 2)
    x = np.random.default_rng(1).normal(size=(20, 20))
    u, s, v = orthogonal.jacobi(x * d)
    # The inverse's largest values tell the smallest of these, as the scaling is exact.
    back = orthogonal.jacobi(np.linalg.inv(x).T / d)[1]
    assert np.allclose(s * back[::-1], 1, rtol=1e-9)
    assert np.allclose(u * s @ v.T, x * d, rtol=0, atol=1e-14)
    assert orthogonal.jacobi(np.zeros((3, 2)))[1].size == 0


def test_randomized_svd_of_a_wide_matrix(spark):
    """5,000 columns; values that fall fast, in two sectors under one cut."""
    rng = np.random.default_rng(8)
    rows, cols = np.repeat(np.arange(60), 40), rng.integers(0, 5000, 2400)
    parts = {}
    for name, size in (("a", 1.0), ("b", 0.5)):
        m = np.zeros((60, 5000))
        np.add.at(m, (rows, cols), rng.normal(size=2400) * size * 0.7 ** rows)
        parts[name] = m
    u, s, v = linalg.randomized_svd(_cells(spark, parts), 4, "sector", steps=2)
    u, s, v = u.toPandas(), s.toPandas(), v.toPandas()
    exact = {k: np.linalg.svd(m, full_matrices=False) for k, m in parts.items()}
    top = sorted(((x, k) for k, f in exact.items() for x in f[1]), reverse=True)[:4]
    assert np.allclose(sorted(s["v"], reverse=True), [x for x, _ in top], rtol=1e-6)
    for k, (left, own, right) in exact.items():
        n = sum(1 for _, name in top if name == k)
        assert np.allclose(_dense(u, k, (60, 4))[:, :n] * own[:n] @ _dense(v, k, (5000, 4))[:, :n].T, left[:, :n] * own[:n] @ right[:n], atol=1e-5)


def _operator(cells):
    """Columns times the matrices of their sectors."""

    def run(x):
        right = x.select("sector", F.col("i").alias("j"), "k", F.col("v").alias("x"))
        return cells.join(right, ["sector", "j"]).groupBy("sector", "i", "k").agg(F.sum(F.col("v") * F.col("x")).alias("v"))

    return run


def test_eigenpairs_by_sector(spark):
    """Values that repeat, over 256 indices, without symmetry, of rank one, of nothing, and a sector without cells."""
    rng = np.random.default_rng(2)
    many = np.diag(np.r_[5.0, 5, 4, 1 / np.arange(1.0, 298)])
    turn = np.linalg.qr(rng.normal(size=(50, 50)))[0]
    parts = {
        "many": many,
        "both signs": (turn * np.r_[3.0, 3, -3, 1.5, np.linspace(0, 1, 46)]) @ turn.T,
        "turning": rng.normal(size=(30, 30)),
        "one": np.outer(rng.normal(size=20), rng.normal(size=20)),
        "number": np.array([[7.0]]),
    }
    cells = _cells(spark, parts).checkpoint()
    index = pd.concat([pd.DataFrame({"sector": k, "i": np.arange(len(m))}) for k, m in [*parts.items(), ("nothing", np.zeros((4, 4)))]])
    values, vectors = eigenpairs(_operator(cells), spark.createDataFrame(index, "sector string, i bigint"), 3)
    values, vectors = values.toPandas(), vectors.toPandas()
    assert not (values["sector"] == "nothing").any()
    for name, m in parts.items():
        own = values[values["sector"] == name].sort_values("pos")
        found = (own["re"] + 1j * own["im"]).to_numpy()
        exact = np.linalg.eigvals(m)
        size = np.sort(np.abs(exact))[::-1][:3]
        size = size[size > 1e-12 * size[0]]
        assert np.allclose(np.abs(found), size, rtol=1e-9) and np.abs(exact[:, None] - found).min(0).max() < 1e-8 * size[0]
        x = np.zeros((len(m), len(found)), complex)
        of = vectors[vectors["sector"] == name]
        x[of["i"], of["k"]] = of["re"] + 1j * of["im"]
        assert np.allclose(np.linalg.norm(x, axis=0), 1) and np.linalg.norm(m @ x - x * found, axis=0).max() < 1e-8 * size[0]
    assert np.allclose(np.sort(values[values["sector"] == "many"]["re"]), [4, 5, 5])


def test_systems_by_sector(spark):
    """Solved in a task and by gradients; several right sides, one of zeros, sectors without any."""
    rng = np.random.default_rng(6)
    parts = {"a": rng.normal(size=(12, 12)) + 6 * np.eye(12), "b": np.diag(10.0 ** np.arange(-4, 5)) @ (np.eye(9) + 0.3 * np.eye(9, k=1)), "c": np.eye(3)}
    sides = {"a": rng.normal(size=(12, 2)), "b": np.c_[rng.normal(size=9), np.zeros(9)]}
    cells, b = _cells(spark, parts), _cells(spark, sides).withColumnRenamed("j", "k")
    for direct in (1024, 0):
        x = solve(cells, b, "sector", direct=direct).withColumnRenamed("k", "j").toPandas()
        for name, side in sides.items():
            assert np.allclose(parts[name] @ _dense(x, name, side.shape), side, atol=1e-8 * np.abs(parts[name]).max())
        assert not (x["sector"] == "c").any()
    one = b.where("sector = 'a' AND k = 0").select("i", "v")
    assert np.allclose([r.v for r in solve(cells.where("sector = 'a'").drop("sector"), one).orderBy("i").collect()], np.linalg.solve(parts["a"], sides["a"][:, 0]))
    with pytest.raises(ValueError, match="no matrix"):
        solve(cells.where("sector <> 'a'"), b, "sector")
    flat = _cells(spark, {"a": np.ones((3, 3))})
    with pytest.raises(Exception, match="singular"):
        solve(flat, _cells(spark, {"a": np.array([[1.0], [2.0], [3.0]])}).withColumnRenamed("j", "k"), "sector").collect()
    with pytest.raises(ValueError, match="singular|no solution"):
        solve(flat, _cells(spark, {"a": np.array([[1.0], [2.0], [3.0]])}).withColumnRenamed("j", "k"), "sector", direct=0, most=4).collect()


def test_projectors_by_sector(spark):
    """One cut over all sectors; ``P^T Pt`` is the identity on what each keeps, and sectors of one side go."""
    rng = np.random.default_rng(3)
    left, right = ({k: rng.normal(size=(20, n)) * size for k, n, size in own} for own in ([("a", 4, 3.0), ("b", 3, 1.0), ("x", 2, 1.0)], [("a", 5, 1.0), ("b", 3, 1.0), ("y", 2, 9.0)]))
    cut = linalg.two_sided_projectors(_cells(spark, left), _cells(spark, right), 4, spark.createDataFrame([("a", 1), ("b", 2)], "sector string, dim int"))
    p, pt = (x.toPandas() for x in cut)
    values = sorted(((s, k) for k in ("a", "b") for s in np.linalg.svd(left[k].T @ right[k], compute_uv=False)), reverse=True)
    kept, total = {"a": 0, "b": 0}, 0
    for _, k in values:
        if total < 4:
            kept[k], total = kept[k] + 1, total + (1 if k == "a" else 2)
    assert {k: p[p["sector"] == k]["j"].nunique() for k in ("a", "b")} == kept and set(p["sector"]) <= {"a", "b"}
    for k, n in kept.items():
        a, b = _dense(p, k, (20, 5))[:, :n], _dense(pt, k, (20, 5))[:, :n]
        assert np.allclose(a.T @ b, np.eye(n), atol=1e-10)


def test_block_times_and_what_factors_leave_out(spark):
    """Any number of columns; the energy left out is that of the dense difference, and no plan forms it."""
    rng = np.random.default_rng(8)
    parts = {"a": rng.normal(size=(30, 12)) * (rng.random((30, 12)) < 0.4), "b": rng.normal(size=(5, 40)) * (rng.random((5, 40)) < 0.5)}
    cells = _cells(spark, parts)
    xs = {k: rng.normal(size=(m.shape[1], 19)) for k, m in parts.items()}
    image = block_times(cells, _cells(spark, xs).withColumnRenamed("j", "k")).withColumnRenamed("k", "j").toPandas()
    for k, m in parts.items():
        assert np.allclose(_dense(image, k, (len(m), 19)), m @ xs[k], rtol=0, atol=1e-12)
    us, vs, ss = {k: rng.normal(size=(len(m), 3)) for k, m in parts.items()}, {k: rng.normal(size=(m.shape[1], 3)) for k, m in parts.items()}, [3.0, 2.0, 0.5]
    weights = spark.createDataFrame([(k, p, 1, v) for k in parts for p, v in enumerate(ss)], "sector string, pos bigint, dim int, v double")
    out = linalg.left_out(cells, _cells(spark, us), weights, _cells(spark, vs), "sector")
    assert "Cartesian" not in out._jdf.queryExecution().toString()
    lost = {r.sector: r.lost for r in out.collect()}
    for k, m in parts.items():
        assert np.isclose(lost[k], ((m - us[k] * ss @ vs[k].T) ** 2).sum(), rtol=1e-12)


def test_bases_are_deleted_once_the_next_is_written(spark):
    import os

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    m = np.diag(np.arange(1.0, 41))
    cells = _cells(spark, {"a": m})
    before = set(os.listdir(folder))
    values, vectors = eigenpairs(lambda x: block_times(cells, x), cells.select("sector", "i"), 2)
    assert np.allclose(sorted(values.toPandas()["re"]), [39, 40]) and vectors.count() > 0
    new = [spark.read.parquet(f"file:{folder}/{d}").columns for d in set(os.listdir(folder)) - before if not d.startswith("rdd-")]
    assert new and not any("q" in c for c in new)


def test_svd_deals_rows_to_tasks_by_bounded_parts(spark, monkeypatch):
    """A sector of 4,000 cells and one of 12, in parts of about 128 cells: no task makes more than a few parts' worth of ``U``."""
    monkeypatch.setattr(orthogonal, "PART", 128)
    rng = np.random.default_rng(21)
    parts = {"a": rng.normal(size=(1000, 4)), "b": rng.normal(size=(4, 3))}
    u, s, v = linalg.svd(_cells(spark, parts), "sector")
    held = u.groupBy(F.spark_partition_id().alias("task")).count().toPandas()
    assert held["count"].max() <= 8 * 128 and held["count"].sum() == 4012
    own, right, weights = (x.toPandas() for x in (u, v, s))
    for k, m in parts.items():
        values = weights[weights["sector"] == k].sort_values("pos")["v"].to_numpy()
        a, b = np.zeros(m.shape), np.zeros((m.shape[1], m.shape[1]))
        for x, table in ((a, own), (b, right)):
            table = table[table["sector"] == k]
            x[table["i"], table["j"]] = table["v"]
        assert np.allclose(values, np.linalg.svd(m, compute_uv=False)) and np.allclose(a * values @ b.T, m)


def test_product_sums_cells_of_one_place_and_keeps_row_names(spark):
    """Rows named by strings, one without a name; a cell in two pieces; a column that the small matrix hasn't."""
    small = spark.createDataFrame([(1, 0, 5, 2.0), (1, 0, 6, 1.0), (1, 1, 5, -1.0)], "sector int, i bigint, j bigint, v double")
    rows = [(1, "x", 0, 1.0), (1, "x", 0, 2.0), (1, "x", 1, 6.0), (1, None, 1, 3.0), (1, "y", 2, 9.0), (2, "z", 0, 1.0)]
    got = linalg.product(spark.createDataFrame(rows, "sector int, i string, j bigint, v double"), small).collect()
    assert {(r.sector, r.i, r.j, r.v) for r in got} == {(1, "x", 6, 3.0), (1, None, 5, -3.0)}
