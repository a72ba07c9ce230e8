"""Eigenpairs by polar factors against LAPACK, and whitening against dense arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorframe.llm.whitening import eigenpairs, polar, whitened

SCHEMA = "vec_id bigint, embedding array<float>"


def _symmetric(values, seed=3):
    n = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize("values", [[], [2.0], [1.0, 1.0, 1.0], [3.0, 0.0, 0.0], [-1.0, 4.0, 2.0, -7.0], np.resize([5.0, 2.0, 0.0], 60), 10.0 ** -np.arange(12.0), 1 + 1e-13 * np.arange(20.0), np.linspace(0, 1, 130)])
def test_eigenpairs(values):
    a = _symmetric(np.array(values, float))
    found, vectors = eigenpairs(a)
    top = max(np.abs(values), default=1.0)
    assert np.allclose(found, np.sort(values)[::-1], rtol=0, atol=1e-13 * top)
    assert np.allclose(a @ vectors, vectors * found, rtol=0, atol=1e-13 * top)
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)


def test_the_polar_factor_is_the_sign():
    values = np.array([5.0, 1e-9, -1e-9, -3.0])
    a = _symmetric(values)
    w, v = np.linalg.eigh(a)
    assert np.allclose(polar(a), (v * np.sign(w)) @ v.T, atol=1e-6)


def _expected(rows, components):
    kept = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * c)) + 1000000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(0)
    z = n * x - s
    y = z.astype(float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > 1e-11 * values[0]).sum()))
    return [k for k, _ in kept], n, (z * z).sum(1), y @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def _rows(n, dims, seed=5):
    random = np.random.default_rng(seed)
    x = random.standard_normal((n, dims)) * np.linspace(0.2, 3, dims) + 7
    return [(k, [float(c) for c in v]) for k, v in enumerate(x.astype(np.float32))]


def test_whitened_equals_dense_arrays(spark):
    """Null ids and vectors, entries that are null or not finite, repeated rows and ids, columns of clashing names."""
    rows = _rows(400, 9)
    rows += [(None, rows[5][1]), (3, rows[5][1]), rows[7], (900, None), (901, [None] * 9), (902, [float("nan")] + [1.0] * 8), (903, [1.0] * 8 + [float("-inf")])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("a") for c in ("x", "n", "component", "deviation")}).repartition(3)
    got = whitened(df, 5).toPandas()
    ids, n, deviation, w, explained = _expected(rows, 5)
    assert set(got["n"]) == {n} and len(got) == 5 * n and got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-10
    got["id"] = got["vec_id"].fillna(-1)
    for c in range(5):
        own = got[got["component"] == c + 1].sort_values(["id", "whitened"])
        sign = np.sign((own.groupby("id")["whitened"].first() * [w[ids.index(None if k < 0 else int(k)), c] for k in own["id"].unique()]).sum())
        want = sorted((-1 if k is None else k, sign * w[r, c], int(deviation[r])) for r, k in enumerate(ids))
        assert np.allclose(own["whitened"], [x[1] for x in want], atol=1e-9)
        assert sorted(own["deviation"]) == sorted(x[2] for x in want)
        assert np.allclose(own["explained"], explained[c], rtol=1e-10)


def test_directions_without_variance_give_no_components(spark):
    rows = [(k, [float(c) for c in v[:3]] + [1.0, float(v[0])]) for k, v in _rows(50, 3)]
    assert whitened(spark.createDataFrame(rows, SCHEMA)).agg(F.max("component")).head()[0] == 3
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([(1, None)], SCHEMA)).collect() == []
    assert whitened(spark.createDataFrame([], SCHEMA)).collect() == []


def test_vectors_of_several_lengths_raise(spark):
    with pytest.raises(ValueError, match="one length"):
        whitened(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], SCHEMA))


def test_large_deviations_are_exact_or_raise(spark):
    rows = [(1, [1e6, 0.0]), (2, [-1e6, 3.0]), (3, [5e5, 1.0])]
    got = {r.vec_id: r.deviation for r in whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict(zip((1, 2, 3), [int(x) for x in _expected(rows, 2)[2]], strict=True))
    with pytest.raises(Exception, match=r"(?i)overflow|too large|too big|out of range"):
        whitened(spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 3.0])], SCHEMA)).collect()
