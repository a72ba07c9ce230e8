"""Hot legs against plain contractions, and costed orders against all orders and the greedy one."""

import math

import numpy as np
import pytest

from sectorframe.operators import joins, skew
from sectorframe.plans import chains, orders


def table(spark, rows, *legs):
    return spark.createDataFrame(rows, ", ".join(f"{c} bigint" for c in legs) + ", v double")


def values(df):
    return sorted(map(tuple, df.collect()), key=repr)


def skewed(seed, n, other):
    """Half of all cells at leg 7, some at no leg."""
    rng = np.random.default_rng(seed)
    legs = np.where(rng.random(n) < 0.5, 7, rng.integers(0, 200, n))
    cells = {(int(j), int(k)): float(rng.integers(1, 9)) for j, k in zip(legs, rng.integers(0, other, n), strict=True)}
    return [(None, 1, 2.0), *[(j, k, v) for (j, k), v in cells.items()]]


def test_hot_legs_are_those_over_a_share(spark):
    cells = table(spark, skewed(1, 2000, 10**6), "j", "k")
    counts = {r.j: r["count"] for r in cells.where("j is not null").groupBy("j").count().collect()}
    share = sum(counts.values()) / 50
    expected = {j: math.ceil(n / share) for j, n in counts.items() if n > share}
    assert expected and {r.j: r.blocks for r in skew.hot_legs(cells, ["j"], 50).collect()} == expected
    assert skew.hot_legs(cells.limit(0), ["j"], 50).count() == 0


@pytest.mark.parametrize("both", [True, False])
def test_split_contract_equals_contract(spark, both):
    a = table(spark, skewed(1, 1500, 40), "j", "i")
    b = table(spark, skewed(2, 1500, 30), "j", "k") if both else table(spark, [(j, j % 5, 2.0) for j in range(200)] + [(None, 0, 1.0)], "j", "k")
    expected = values(joins.contract(a, b, ["j"], ["i", "k"]))
    assert len(expected) > 100
    assert values(skew.split_contract(a, b, ["j"], ["i", "k"], parts=20)) == expected
    assert values(skew.split_contract(a, b, ["j"], ["i", "k"])) == expected
    assert values(skew.split_contract(a.limit(0), b, ["j"], ["i", "k"], parts=20)) == []


def test_blocks_divide_a_hot_leg(spark):
    a, b = table(spark, skewed(3, 4000, 10**6), "j", "i"), table(spark, skewed(4, 4000, 10**6), "j", "k")
    hot = skew.hot_legs(a, ["j"], 20).withColumnRenamed("blocks", "_left").join(skew.hot_legs(b, ["j"], 20).withColumnRenamed("blocks", "_right"), "j", "full")
    dealt = skew._dealt(a, hot, ["j"], "_left", "_right", ("_p", "_q"))
    keys = [r["count"] for r in dealt.groupBy("j", "_p", "_q").count().collect()]
    assert max(r["count"] for r in a.groupBy("j").count().collect()) > 1900
    assert max(keys) < 1.5 * 4000 / 20


def network(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(3, 6))
    # A chain holds the tables together; other legs go anywhere.
    legs = [{} for _ in range(n)]
    for k in range(n - 1):
        legs[k][f"c{k}"] = legs[k + 1][f"c{k}"] = 0.0
    for k in range(3):
        for t in rng.choice(n, 2, replace=False):
            legs[t][f"x{k}"] = 0.0
    legs = [{leg: float(rng.integers(1, 1000)) for leg in own} for own in legs]
    return orders.Network([float(rng.integers(1, 10**6)) for _ in range(n)], legs, frozenset(["x0"]))


def all_orders(n):
    if n == 1:
        yield []
    for a in range(n):
        for b in range(a + 1, n):
            for rest in all_orders(n - 1):
                yield [(a, b), *rest]


@pytest.mark.parametrize("seed", range(12))
def test_best_order_is_the_cheapest(seed):
    own = network(seed)
    found = own.cost(own.best_order())
    everything = (1 << len(own.rows)) - 1
    greedy = chains.cheapest_order([list(x) for x in own.legs], {leg: own.distinct(everything, leg) for leg in own.of}, ["x0"])
    assert found <= own.cost(greedy) * (1 + 1e-12)
    assert math.isclose(found, min(own.cost(o) for o in all_orders(len(own.rows))), rel_tol=1e-9)


def test_orders_of_many_tables_and_of_tables_apart():
    chain = orders.Network([9.0] * 15, [{f"c{k}": 3.0, f"c{k + 1}": 3.0} for k in range(15)], frozenset(["c0", "c15"]))
    assert len(chain.best_order()) == 14 and chain.cost(chain.best_order()) < math.inf
    with pytest.raises(ValueError, match="common leg"):
        orders.Network([5.0, 5.0], [{"a": 5.0}, {"b": 5.0}], frozenset()).best_order()
    assert orders.Network([5.0], [{"a": 5.0}], frozenset()).best_order() == []


def test_measured_chain_equals_a_dense_product(spark):
    rng = np.random.default_rng(5)
    a, b, c, d = (rng.integers(1, 9, shape) for shape in ((6, 30), (30, 4), (4, 20), (20, 3)))
    tables = [table(spark, [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], *legs) for m, legs in ((a, "pq"), (b, "qr"), (c, "rs"), (d, "st"))]
    order = orders.measured_order(tables, ["p", "t"])
    got = chains.contract_chain(tables, ["p", "t"], order)
    dense = a @ b @ c @ d
    assert {(r.p, r.t): r.v for r in got.collect()} == {(i, j): float(dense[i, j]) for i in range(6) for j in range(3)}
