"""Operators against dense arrays, greedy loops and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorframe.functions import keys
from sectorframe.operators import aggregates, joins, linalg, ranking, sets, validation
from sectorframe.plans import chains
from sectorframe.sources import cells as sources


def to_cells(spark, m, sector=None):
    rows = [(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    if sector is None:
        return spark.createDataFrame(rows, "i bigint, j bigint, v double")
    return spark.createDataFrame([(i, j, sector, v) for i, j, v in rows], "i bigint, j bigint, sector int, v double")


def to_array(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.i, r.j] = r.v
    return out


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(42).normal(size=(12, 5))


def weights_table(spark, rows):
    return spark.createDataFrame(rows, "sector int, pos bigint, dim int, v double")


def greedy(rows, target, cutoff, ratio):
    left, kept, count = sorted(rows, key=lambda r: -r[3]), [], 0
    while left and left[0][3] > cutoff and count < target:
        bound = ratio * left[0][3]
        while left and left[0][3] >= bound:
            count += left[0][2]
            kept.append(left.pop(0))
    return sorted(kept)


@pytest.mark.parametrize("ratio", [1.0, 0.9, 0.7])
@pytest.mark.parametrize("seed", range(3))
def test_cut_equals_a_greedy_loop(spark, ratio, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(3)), k, int(rng.integers(1, 4)), float(rng.integers(0, 25))) for k in range(60)]
    for target in (1, 17, 10**6):
        got = ranking.cut_multiplets(weights_table(spark, rows), target, ratio=ratio).collect()
        cutoff = len(rows) * np.finfo(float).eps * max(r[3] for r in rows)
        assert sorted(map(tuple, got)) == greedy(rows, target, cutoff, ratio)


def test_cut_edges(spark):
    equal = [(0, k, 2, 1.5) for k in range(9)]
    assert ranking.cut_multiplets(weights_table(spark, equal), 1).count() == 9
    assert ranking.cut_multiplets(weights_table(spark, []), 5).count() == 0
    assert ranking.cut_multiplets(weights_table(spark, equal), 0).count() == 0
    assert ranking.cut_multiplets(weights_table(spark, equal), 5, atol=2.0).count() == 0


def test_sums_keep_the_tail_of_either_side(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (5, 5, 2.0), (9, 9, 4.0)], "i bigint, j bigint, v double")
    b = spark.createDataFrame([(0, 0, 1.0)], "i bigint, j bigint, v double")
    assert sorted(map(tuple, joins.add(b, a).collect())) == [(0, 0, 2.0), (5, 5, 2.0), (9, 9, 4.0)]
    assert sorted(map(tuple, joins.sub(a, a).collect())) == [(0, 0, 0.0), (5, 5, 0.0), (9, 9, 0.0)]


def test_products_and_norms(spark, matrix):
    a, b = to_cells(spark, matrix), to_cells(spark, matrix.T.copy())
    product = joins.contract(a.withColumnRenamed("j", "k"), b.withColumnRenamed("i", "k"), ["k"], ["i", "j"])
    assert np.allclose(to_array(product, (12, 12)), matrix @ matrix.T)
    assert np.isclose(joins.full_contract(a, b).head().v, (matrix**2).sum())
    assert np.isclose(aggregates.norm(a).head().norm, np.linalg.norm(matrix))
    assert np.isclose(aggregates.trace(product).head().trace, np.trace(matrix @ matrix.T))
    assert np.isclose(aggregates.asymmetry(to_cells(spark, matrix[:5])).head().asymmetry, np.linalg.norm(matrix[:5] - matrix[:5].T))
    cells, log = aggregates.normalise(a)
    assert np.isclose(aggregates.norm(cells).head().norm, 1) and np.isclose(np.exp(log), np.linalg.norm(matrix))
    empty = a.limit(0)
    assert aggregates.norm(empty).head().norm == 0 and aggregates.trace(empty).head().trace == 0
    with pytest.raises(ZeroDivisionError):
        aggregates.normalise(empty)


def test_chain_equals_einsum_in_any_order(spark):
    rng = np.random.default_rng(1)
    x, y, z = rng.normal(size=(3, 4)), rng.normal(size=(4, 5)), rng.normal(size=(5, 2))
    tables = [to_cells(spark, m).toDF(*legs, "v") for m, legs in ((x, "ab"), (y, "bc"), (z, "cd"))]
    for how in ({}, {"order": [(1, 2), (0, 1)]}, {"sizes": {"a": 3, "b": 4, "c": 5, "d": 2}}):
        got = chains.contract_chain(tables, ["a", "d"], **how).toDF("i", "j", "v")
        assert np.allclose(to_array(got, (3, 2)), x @ y @ z)
    with pytest.raises(ValueError):
        chains.contract_chain([tables[0], tables[2], tables[1]], ["a", "d"])


def test_factors(spark, matrix):
    cells = to_cells(spark, matrix)
    q, r = linalg.qr(cells)
    q, r = to_array(q, (12, 5)), to_array(r, (5, 5))
    assert np.allclose(q @ r, matrix) and np.allclose(q.T @ q, np.eye(5)) and np.allclose(r, np.triu(r))
    low, own = linalg.rq(to_cells(spark, matrix.T.copy()))
    assert np.allclose(to_array(low, (5, 5)) @ to_array(own, (5, 12)), matrix.T)
    u, s, v = linalg.svd(cells)
    values = np.array([x.v for x in s.orderBy("pos").collect()])
    assert np.allclose(values, np.linalg.svd(matrix, compute_uv=False))
    assert np.allclose(to_array(u, (12, 5)) * values @ to_array(v, (5, 5)).T, matrix)
    u, s, v = linalg.truncated_svd(cells, 2, None)
    assert s.count() == 2 and to_array(u, (12, 2)).shape == (12, 2)
    empty = cells.limit(0)
    assert linalg.qr(empty)[0].isEmpty() and linalg.svd(empty)[1].isEmpty() and linalg.pinv_fit(empty, empty.select("i", "v")).isEmpty()


def test_factors_by_sector(spark):
    """Three sectors of other shapes, each against dense arrays; the cut takes the largest values of all."""
    rng = np.random.default_rng(12)
    parts = {1: rng.normal(size=(9, 4)), 2: rng.normal(size=(5, 3)), 7: rng.normal(size=(6, 1))}
    cells = None
    for k, m in parts.items():
        own = to_cells(spark, m).withColumn("sector", F.lit(k))
        cells = own if cells is None else cells.unionByName(own)
    q, r = linalg.qr(cells, "sector")
    u, s, v = linalg.svd(cells, "sector")
    for k, m in parts.items():
        n, width = m.shape
        own = [to_array(x.where(F.col("sector") == k), shape) for x, shape in ((q, m.shape), (r, (width, width)), (u, m.shape), (v, (width, width)))]
        values = np.array([x.v for x in s.where(F.col("sector") == k).orderBy("pos").collect()])
        assert np.allclose(own[0] @ own[1], m) and np.allclose(own[0].T @ own[0], np.eye(width)) and np.allclose(own[1], np.triu(own[1]))
        assert np.allclose(values, np.linalg.svd(m, compute_uv=False)) and np.allclose(own[2] * values @ own[3].T, m)
    _, kept, right = linalg.truncated_svd(cells, 3)
    every = np.sort(np.concatenate([np.linalg.svd(m, compute_uv=False) for m in parts.values()]))[::-1]
    assert np.allclose(sorted((x.v for x in kept.collect()), reverse=True), every[:3])
    assert right.select("sector", "j").distinct().count() == 3


def test_solvers(spark, matrix):
    b = np.random.default_rng(2).normal(size=12)
    target = spark.createDataFrame([(k, float(x)) for k, x in enumerate(b)], "i bigint, v double")
    x = {r.j: r.v for r in linalg.pinv_fit(to_cells(spark, matrix), target).collect()}
    assert np.allclose([x[k] for k in range(5)], np.linalg.pinv(matrix) @ b)
    rows = [("a", float(k), 3.0 * k + 1) for k in range(5)] + [("b", 1.0, 2.0)]
    table = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: r.coef for r in linalg.solve_by_group(table, ["g"], ["x"], "y").collect()}
    assert np.allclose(got["a"], [3, 1]) and got["b"] is None
    with pytest.raises(ValueError):
        linalg.solve_by_group(table, ["g"], ["x"], "y", spark.createDataFrame([("c",)], "g string"))


def test_spectra(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(6, 6))
    m = m + m.T
    cells = to_cells(spark, m).withColumn("g", F.lit(1))
    got = [r.v for r in linalg.eigh_by_group(cells, "g").orderBy("pos").collect()]
    values = np.linalg.eigvalsh(m)
    assert np.allclose(got, values[np.argsort(-np.abs(values))])
    turn = to_cells(spark, np.array([[0.0, -1.0], [1.0, 0.0]])).withColumn("g", F.lit(1))
    assert sorted((round(r.v.re, 9), round(r.v.im, 9)) for r in linalg.eig_by_group(turn, "g").collect()) == [(0.0, -1.0), (0.0, 1.0)]
    with pytest.raises(Exception):
        linalg.eigh_by_group(cells, "g", limit=3).collect()
    spread = np.diag([9.0, -4.0, 2.0, 1.0, 0.5, 0.1])
    base = to_cells(spark, spread)
    start = spark.createDataFrame([(i, k, float(rng.normal())) for i in range(6) for k in range(2)], "i bigint, k bigint, v double")
    pairs = linalg.eigh_by_group(cells, "g").collect()
    assert all(np.allclose(m @ np.array(r.vector), r.v * np.array(r.vector)) for r in pairs)
    found, vectors = linalg.top_eigen(_product(base), start, 2)
    assert np.allclose([r.re for r in found.orderBy("pos").collect()], [9, -4])
    assert {(r.k, r.i): round(abs(r.re), 6) for r in vectors.collect() if abs(r.re) > 1e-6} == {(0, 0): 1, (1, 1): 1}


def _product(base):
    return lambda x: joins.contract(base, x.withColumnRenamed("i", "j"), ["j"], ["i", "k"])


def test_eigenpairs_of_an_operator(spark):
    """Of a sparse matrix without symmetry, by a Krylov basis; sectors that it lacks give nothing."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(30, 30)) / 8 + np.diag(np.r_[6, -5, 4.5, np.zeros(27)])
    m[20:] = m[:, 20:] = 0
    start = spark.createDataFrame([(i, k, float(rng.normal())) for i in range(30) for k in range(3)], "i bigint, k bigint, v double")
    values, vectors = linalg.top_eigen(_product(to_cells(spark, m)), start, 3)
    expected = np.linalg.eigvals(m)
    expected = expected[np.argsort(-np.abs(expected))][:3]
    assert np.allclose([complex(r.re, r.im) for r in values.orderBy("pos").collect()], expected, atol=1e-9)
    x = np.zeros((30, 3), complex)
    for r in vectors.collect():
        x[r.i, r.k] = complex(r.re, r.im)
    assert np.allclose(m @ x, x * expected, atol=1e-8)
    none = to_cells(spark, m).limit(0)
    assert all(linalg.top_eigen(_product(none), x, 3)[0].isEmpty() for x in (start, start.limit(0)))


def test_no_moves_and_large_steps(spark):
    none = spark.createDataFrame([], "i string, j string, v double")
    spectrum = linalg.transition_spectrum(none, 3)
    assert spectrum.isEmpty() and linalg.mixing_length(spectrum).isEmpty()
    edges = spark.createDataFrame([(0, 0, -30.0), (0, 1, 1.0), (1, 1, -2.0)], "i bigint, j bigint, v double")
    x = spark.createDataFrame([(0, 1.0), (1, 1.0)], "i bigint, v double")
    got = {r.i: r.v for r in linalg.expm_apply(edges, x, 1.0, 14).collect()}
    assert np.isclose(got[1], np.exp(-2)) and np.isclose(got[0], np.exp(-30) + (np.exp(-2) - np.exp(-30)) / 28)
    weights = weights_table(spark, [(0, 0, 1, 2.0), (0, 1, 1, float("nan"))])
    with pytest.raises(ValueError, match="no numbers"):
        ranking.cut_multiplets(weights, 2)


def test_projectors_and_diffusion(spark):
    rng = np.random.default_rng(4)
    r, rt = rng.normal(size=(20, 4)), rng.normal(size=(20, 5))
    p, pt = linalg.two_sided_projectors(to_cells(spark, r), to_cells(spark, rt), 3)
    assert np.allclose(to_array(p, (20, 3)).T @ to_array(pt, (20, 3)), np.eye(3), atol=1e-8)
    m, x = rng.random(size=(4, 4)), np.arange(4.0)
    start = spark.createDataFrame([(k, float(v)) for k, v in enumerate(x)], "i bigint, v double")
    got = {q.i: q.v for q in linalg.expm_apply(to_cells(spark, m), start, 0.1, 12).collect()}
    series, term = x.copy(), x.copy()
    for k in range(1, 13):
        term = 0.1 / k * (m @ term)
        series += term
    assert np.allclose([got[k] for k in range(4)], series)


def test_key_rules():
    assert set(keys.RULES) >= {"additive", "int8", "const"}
    keys.register_rule("half", lambda q: F.floor(q / 2))
    assert keys.rule("half") is keys.RULES["half"]
    with pytest.raises(KeyError):
        keys.rule("none such")


def test_wrap_and_signs(spark):
    row = spark.range(1).select(
        keys.combined([F.lit(100), F.lit(100)], [False, False], "int8").alias("up"),
        keys.combined([F.lit(-128), F.lit(1)], [False, True], "int8").alias("down"),
        keys.combined([F.lit(-3), F.lit(1)], [False, False], "mod 2").alias("odd"),
    ).head()
    assert (row.up, row.down, row.odd) == (-56, 127, 0)


def test_permute_needs_a_permutation(spark):
    cells = spark.createDataFrame([(1, 2, 3.0)], "i bigint, j bigint, v double")
    assert tuple(keys.permute(cells, ["j", "i"], ["i", "j"]).head()) == (2, 1, 3.0)
    assert keys.permute(cells, ["i", "j"], ["i", "j"]) is cells
    with pytest.raises(ValueError):
        keys.permute(cells, ["i", "i"], ["i", "j"])


def test_save_load_and_tags(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 5, 2.0), (1, 1, -3, 1.0)], "i bigint, j bigint, sector int, v double")
    sources.save_cells(cells, str(tmp_path), "x", "additive", ["i", "j"], [False, True])
    assert sorted(map(tuple, sources.load_cells(spark, str(tmp_path), "x", "additive").collect())) == sorted(map(tuple, cells.collect()))
    assert sources.saved(spark, str(tmp_path), ["x"]).head().signature == [False, True]
    with pytest.raises(ValueError):
        sources.load_cells(spark, str(tmp_path), "x", "const")


def test_nulls_are_refused(spark):
    table = spark.createDataFrame([(1, [1.0, None])], "id bigint, a array<double>")
    with pytest.raises(Exception, match="null element"):
        sources.cells_from_arrays(table, "id", "a").collect()


def test_histograms(spark):
    hist = spark.createDataFrame([(1, 2), (3, 5)], "key int, n bigint")
    assert keys.format_hist(hist).head().hist == "2*1 + 5*3"
    text = spark.createDataFrame([("2*1 + 5*3",), ("",)], "t string")
    assert sorted(map(tuple, keys.parse_hist(text, "t").collect())) == [(1, 2), (3, 5)]
    assert tuple(aggregates.hist_stats(hist).head()) == (17, 2, 3, True, False)
    assert sorted(map(tuple, aggregates.hist_convolve(hist, hist).collect())) == [(2, 4), (4, 20), (6, 25)]
    catalog = ranking.catalog_from_hist(hist)
    assert [(r.idx, r.q) for r in catalog.orderBy("idx").collect()] == [(0, 1), (1, 1), *[(k, 3) for k in range(2, 7)]]
    assert sorted(map(tuple, ranking.hist_from_catalog(catalog).collect())) == [(1, 2), (3, 5)]
    assert tuple(ranking.singlet(spark).head()) == (0, 1)


def test_logs_and_entropy(spark):
    rows = [("plus", 2.0, 1), ("plus", -3.0, 1), ("plus", -1.0, -1), ("minus", -2.0, 1), ("zero", 0.0, 1), ("zero", 5.0, 1), ("pole", 0.0, -1), ("both", 0.0, 1), ("both", 0.0, -1)]
    got = {r.g: r.log_product for r in aggregates.signed_log_product(spark.createDataFrame(rows, "g string, x double, e int"), ["g"]).collect()}
    assert np.isclose(got["plus"], np.log(6)) and np.isnan(got["minus"]) and got["zero"] == -np.inf and got["pole"] == np.inf and np.isnan(got["both"])
    table = weights_table(spark, [(0, 0, 2, 1.0), (0, 1, 1, 2.0), (0, 2, 5, 0.0)])
    p = np.array([0.25, 0.25, 0.5])
    assert np.isclose(aggregates.entropy(table, ["sector"]).head().entropy, -(p * np.log(p)).sum())


def test_sectors(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "sector int") for v in ([1, 1, 2], [2, 3]))
    assert sorted(r.sector for r in sets.sector_union(a, b).collect()) == [1, 2, 3]
    assert [r.sector for r in sets.sector_intersect(a, b).collect()] == [2]
    assert [r.sector for r in joins.missing_sectors(a, b).collect()] == [1]


def test_checks(spark):
    bonds = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (0, 1, 1), (0, 2, 1), (1, 1, 3), (2, 0, 3)], "tensor int, slot int, bond bigint")
    assert sorted(map(tuple, validation.check_bond_table(bonds).collect())) == [(1, 2, "twice"), (2, 0, "missing")]
    cells = spark.createDataFrame([(0, 0, 1.0, 0, 0), (0, 1, 1e-3, 0, 1)], "i bigint, j bigint, v double, row_sector int, col_sector int")
    assert not validation.off_sector_mass(cells).head().ok
    with pytest.raises(ValueError):
        validation.require_on_sector(cells)
    assert validation.require_on_sector(cells.where("j = 0")).count() == 1
    catalog = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 2)], "leg int, idx bigint, q int")
    assert validation.check_square(catalog, [0], [1], [False, True]).isEmpty()
    with pytest.raises(ValueError):
        validation.check_square(catalog, [0], [1], [True, True])
    assert validation.match_layout(catalog, catalog, [False], [False]) and not validation.match_layout(catalog, keys.dual(catalog), [False], [False])
    weights = weights_table(spark, [(0, 0, 1, 2.0)])
    assert joins.weights_combine(weights, weights, "*").head().v == 4
    with pytest.raises(ValueError):
        joins.weights_combine(weights, weights_table(spark, [(1, 0, 1, 2.0)]), "*")


def test_plans_have_no_products_of_indices(spark, sf_dir):
    from sectorframe.queries import QUERIES

    for name in ("j1_contract", "j2_add", "r1_cut_multiplets", "d3_partial_trace"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_flat_indices_go_back_whatever_their_size(spark):
    rows = spark.createDataFrame([(0, 0), (3, 1_200_000), (60_000, 1_199_999), (9_000_000_000, 1_000_003)], "i bigint, j bigint")
    shape = keys.shape_of(rows, ["i", "j"])
    assert shape == [9_000_000_001, 1_200_001]
    back = keys.unravel(keys.ravel([F.col("i"), F.col("j")], shape), shape)
    assert rows.where((back[0] != F.col("i")) | (back[1] != F.col("j"))).count() == 0


def test_flat_index_query_with_many_parts(spark, tmp_path):
    from sectorframe.queries import QUERIES

    spark.createDataFrame([(2, 1_100_000, 3.0), (2, 5, 1.0), (1, 1_000_003, 1.0)], "l_suppkey bigint, l_partkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {tuple(r) for r in QUERIES["p9_ravel"](spark, str(tmp_path)).collect()}
    assert got == {(i, j, i * 1000003 + j, i, j) for i, j in ((2, 1_100_000), (2, 5), (1, 1_000_003))}


def test_a_cut_reads_its_weights_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(5000).selectExpr("0 AS sector", "id AS pos", "1 AS dim", "cast(id % 997 AS double) AS v")
    kept = ranking.cut_multiplets(rows.mapInArrow(told, rows.schema), 40, ratio=0.97)
    assert kept.count() > 40 and seen.value == 5000


def test_facts_dealt_by_parts_and_random_cells_by_blocks(spark, monkeypatch):
    """The same sums in so many tasks; pairs of any sector are made in several tasks, though one side is small."""
    facts = spark.range(600).selectExpr("id % 7 AS a", "id % 11 AS b", "cast(id % 5 AS double) AS q")
    legs = {"i": "a", "j": "b"}
    dealt = sources.cells_from_facts(facts, legs, "q", parts=9)
    assert dealt.rdd.getNumPartitions() == 9
    assert {tuple(r) for r in dealt.collect()} == {tuple(r) for r in sources.cells_from_facts(facts, legs, "q").collect()}
    monkeypatch.setattr(sources, "BLOCK", (8, 16))
    rows, cols = (spark.range(n).selectExpr("id AS idx", "cast(id % 2 AS int) AS sector") for n in (50, 300))
    pairs = sources.random_cells(rows, cols, seed=3).withColumn("task", F.spark_partition_id())
    got = pairs.toPandas()
    assert sorted(zip(got["i"], got["j"], strict=True)) == [(i, j) for i in range(50) for j in range(300) if (i - j) % 2 == 0]
    assert got["v"].between(-0.5, 0.5, "left").all() and got["task"].nunique() > 5
