"""Queries of factorisations, grouped solvers, spectra and projections.

Vectors have free signs and rotations, so what SQL can also compute is an invariant of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import aggregates, linalg
from ..operators.blocks import Blocks, reindexed, summed
from ..operators.joins import contract, scale_legs, sub
from ..operators.lineage import cut
from ..operators.solvers import solve
from .registry import query


@query("l1_gram", "SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM vectors a JOIN vectors b ON a.i = b.i GROUP BY 1, 2", "vectors")
def _(t):
    return linalg.gram_of_arrays(t.embeddings, "embedding").withColumn("v", F.round("v", 6) + 0.0)


def _gram_by_label(t):
    return linalg.gram_of_arrays(t.embeddings, "embedding", ["label"]).withColumnRenamed("label", "sector")


@query("l1_gram_by_sector", "SELECT a.sector AS sector, a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM vectors a JOIN vectors b ON a.i = b.i GROUP BY 1, 2, 3", "vectors")
def _(t):
    return _gram_by_label(t).withColumn("v", F.round("v", 6) + 0.0)


@query("l2_qr", "SELECT j % 4 AS sector, i, j, round(v, 6) + 0.0 AS v FROM vectors", "vectors")
def _(t):
    """``Q R`` of each sector, which is the matrix; a sector has a quarter of the columns."""
    q, r = linalg.qr(t.vectors().withColumn("sector", F.col("j") % 4), "sector")
    return linalg.product(q, r).select("sector", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("l2_qr_of_any_rank", "SELECT j % 4 AS sector, count(DISTINCT j) + 1 AS rank, 0.0 AS off FROM vectors GROUP BY 1", "vectors")
def _(t):
    """Beside each sector's columns one that is their sum, and one that differs from the first by a billionth: the rank,
    and the largest part of ``Q R`` less the matrix."""
    own = t.vectors().withColumn("sector", F.col("j") % 4).select("sector", "i", "j", "v")
    total = own.groupBy("sector", "i").agg(F.sum("v").alias("v")).select("sector", "i", (F.col("sector") + 64).alias("j"), "v")
    near = own.where("j < 4").select("sector", "i", (F.col("j") + 68).alias("j"), (F.col("v") + 1e-9 * F.sin("i")).alias("v"))
    cells = own.union(total).union(near)
    q, r = linalg.qr(cells, "sector")
    off = sub(cells, linalg.product(q, r), ["i", "j"]).groupBy((F.col("j") % 4).alias("sector")).agg((F.round(F.max(F.abs("v")), 12) + 0.0).alias("off"))
    return linalg.ranks(r).join(off, "sector")


@query("l3_small_values", "SELECT j % 4 AS sector, count(DISTINCT j) AS n, -6.0 * count(DISTINCT j) AS moved FROM vectors GROUP BY 1", "vectors")
def _(t):
    """Every second column is scaled by 1e-12; the values' product moves by just those factors only if the small ones are right."""
    own = t.vectors().withColumn("sector", F.col("j") % 4).select("sector", "i", "j", "v")
    logs = []
    for scaled in (False, True):
        v = F.when(F.col("j") % 8 >= 4, F.col("v") * 1e-12).otherwise(F.col("v")) if scaled else F.col("v")
        _, s, _ = linalg.accurate_svd(own.withColumn("v", v), "sector")
        logs.append(s.groupBy("sector").agg(F.count("*").alias(f"n{scaled}"), F.sum(F.log10("v")).alias(f"log{scaled}")))
    return logs[0].join(logs[1], "sector").select("sector", F.col("nTrue").alias("n"), F.round(F.col("logTrue") - F.col("logFalse"), 6).alias("moved"))


@query("l2_qr_of_all", "SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM vectors a JOIN vectors b ON a.i = b.i GROUP BY 1, 2", "vectors")
def _(t):
    """``R^T R`` of the whole matrix, which is the Gram matrix."""
    _, r = linalg.qr(t.vectors())
    return linalg.gram(r).withColumn("v", F.round("v", 6) + 0.0)


def _back(u, s, v):
    """``U s V^T`` of each sector: weights go to the small side, and ``U`` is made once for its count and the product."""
    small = scale_legs(v, s, ["j"])
    return linalg.product(cut(u), small.select("sector", F.col("j").alias("i"), F.col("i").alias("j"), "v"))


@query("l3_svd", "SELECT sector, i, j, round(v, 6) + 0.0 AS v FROM vectors", "vectors")
def _(t):
    """``U s V^T`` of each sector, which is the matrix."""
    return _back(*linalg.svd(t.vectors(), "sector")).select("sector", "i", "j", (F.round("v", 6) + 0.0).alias("v"))


@query("l3_singular_energy", "SELECT sector, round(sum(v * v), 6) AS energy FROM vectors GROUP BY 1", "vectors")
def _(t):
    return linalg.singular_values(t.vectors()).groupBy("sector").agg(F.round(F.sum(F.col("v") * F.col("v")), 6).alias("energy"))


@query("l4_truncated_svd", "SELECT round(sum(v * v), 6) AS energy, CAST(40 AS BIGINT) AS kept FROM vectors", "vectors")
def _(t):
    """What the cut leaves out and the energy that it keeps, which are all the energy only if the vectors are right."""
    cells = t.vectors()
    u, s, v = linalg.truncated_svd(cells, 40)
    off = sub(cells, _back(u, s, v)).agg(F.sum(F.col("v") * F.col("v")).alias("lost"))
    return s.agg(F.sum(F.col("v") * F.col("v")).alias("own"), F.count("*").alias("kept")).crossJoin(off).select(F.round(F.col("own") + F.col("lost"), 6).alias("energy"), "kept")


_TOP_VALUE = "x(step, j, v) AS (SELECT 0, j, 1.0::DOUBLE FROM (SELECT DISTINCT j FROM quantity) UNION ALL SELECT step + 1, j, v / sqrt(sum(v * v) OVER ()) FROM (SELECT any_value(step) AS step, q.j, sum(q.v * y.v) AS v FROM quantity q JOIN (SELECT any_value(step) AS step, q.i, sum(q.v * x.v) AS v FROM quantity q JOIN x ON q.j = x.j WHERE x.step < 30 GROUP BY q.i) y ON q.i = y.i GROUP BY q.j))"


@query("l4_randomized_svd", f"WITH RECURSIVE {_TOP_VALUE} SELECT CAST(1 AS BIGINT) AS kept, round(sum(v * v) / 1000, 1) AS energy, round(((SELECT sum(v * v) FROM quantity) - sum(v * v)) / 1000, 1) AS lost FROM (SELECT q.i, sum(q.v * x.v) AS v FROM quantity q JOIN x ON q.j = x.j WHERE x.step = 30 GROUP BY q.i)", "quantity")
def _(t):
    """The largest of a matrix that is large on both sides, and what its vectors leave out, in thousands."""
    cells = linalg.blocked(t.quantity())
    u, s, v = linalg.randomized_svd(cells, 1)
    off = linalg.left_out(cells, u, s, v).agg(F.sum("lost").alias("lost"))
    return s.agg(F.count("*").alias("kept"), F.round(F.sum(F.col("v") * F.col("v")) / 1000, 1).alias("energy")).crossJoin(off.select(F.round(F.col("lost") / 1000, 1).alias("lost")))


def _covariance(t):
    n = t.embeddings.groupBy("label").agg(F.count("*").alias("n"))
    g = linalg.gram_of_arrays(t.embeddings, "embedding", ["label"]).join(n, "label")
    return g.select(F.col("label").alias("sector"), "i", "j", (F.col("v") / F.col("n")).alias("v"))


@query("l5_eigh_by_group", "WITH n AS (SELECT sector, count(DISTINCT i) AS n FROM vectors GROUP BY 1) SELECT a.sector AS sector, a.j AS i, b.j AS j, round(sum(a.v * b.v) / any_value(n), 6) + 0.0 AS v FROM vectors a JOIN vectors b ON a.i = b.i JOIN n ON n.sector = a.sector GROUP BY 1, 2, 3", "vectors")
def _(t):
    """Values times outer products of vectors, which are the covariances."""
    pairs = linalg.eigh_by_group(_covariance(t), "sector")
    one = pairs.select("sector", "pos", "v", F.explode(F.arrays_zip("index", "vector")).alias("x")).select("sector", "pos", "v", F.col("x.index").alias("i"), F.col("x.vector").alias("a"))
    other = one.select("sector", "pos", F.col("i").alias("j"), F.col("a").alias("b"))
    return one.join(other, ["sector", "pos"]).groupBy("sector", "i", "j").agg((F.round(F.sum(F.col("v") * F.col("a") * F.col("b")), 6) + 0.0).alias("v"))


def _moves_by_value(t):
    events = t.events.withColumn("g", (F.col("user_id") % 3).cast("int"))
    return linalg.transitions(events, "user_id", "event_type", ["ts", "event_id"], ["g"])


@query("l6_eig_by_group", "WITH m AS (SELECT g, i, j, count(*) AS n FROM (SELECT CAST(user_id % 3 AS INTEGER) AS g, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type AS j FROM events) WHERE i IS NOT NULL GROUP BY 1, 2, 3), s AS (SELECT g, i, sum(n) AS total FROM m GROUP BY 1, 2), p AS (SELECT g, m.i, m.j, n / total AS v FROM m JOIN s USING (g, i)) SELECT g, round(sum(CASE WHEN i = j THEN v ELSE 0 END), 6) + 0.0 AS trace, 0.0 AS residual FROM p GROUP BY 1")
def _(t):
    """The sum of the values, and the largest part of ``M x - l x`` over all pairs."""
    moves = _moves_by_value(t)
    # Event types are few; their numbers come from their own order.
    kinds = F.array_sort(F.collect_set("i"))
    names = moves.select("i").union(moves.select("j")).agg(kinds.alias("names"))
    cells = moves.crossJoin(names).select("g", (F.array_position("names", F.col("i")) - 1).cast("bigint").alias("i"), (F.array_position("names", F.col("j")) - 1).cast("bigint").alias("j"), "v")
    pairs = linalg.eig_by_group(cells, "g")
    parts = pairs.select("g", "pos", F.col("v").alias("l"), F.explode(F.arrays_zip("index", "vector")).alias("x")).select("g", "pos", "l", F.col("x.index").alias("j"), "x.vector.re", "x.vector.im")
    image = cells.join(parts, ["g", "j"]).select("g", "pos", "i", (F.col("v") * F.col("re")).alias("re"), (F.col("v") * F.col("im")).alias("im"))
    own = parts.select("g", "pos", F.col("j").alias("i"), (F.col("l.im") * F.col("im") - F.col("l.re") * F.col("re")).alias("re"), (F.lit(0.0) - F.col("l.re") * F.col("im") - F.col("l.im") * F.col("re")).alias("im"))
    off = image.union(own).groupBy("g", "pos", "i").agg(F.sum("re").alias("re"), F.sum("im").alias("im")).groupBy("g").agg((F.round(F.max(F.hypot("re", "im")), 6) + 0.0).alias("residual"))
    return pairs.groupBy("g").agg((F.round(F.sum("v.re"), 6) + 0.0).alias("trace")).join(off, "g")


@query(
    "l7_power_steps",
    "WITH x0 AS (SELECT DISTINCT i, 1.0 AS v FROM regional), y1 AS (SELECT a.i, sum(a.v * c.v) AS v FROM regional a JOIN (SELECT b.j, sum(b.v * x0.v) AS v FROM regional b JOIN x0 USING (i) GROUP BY 1) c USING (j) GROUP BY 1), x1 AS (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM y1) AS v FROM y1), y2 AS (SELECT a.i, sum(a.v * c.v) AS v FROM regional a JOIN (SELECT b.j, sum(b.v * x1.v) AS v FROM regional b JOIN x1 USING (i) GROUP BY 1) c USING (j) GROUP BY 1) SELECT i, round(v / (SELECT sqrt(sum(v * v)) FROM y2), 6) AS v FROM y2",
    "regional",
)
def _(t):
    cells = t.regional()

    def squared(x):
        """``M M^T x``."""
        inner = contract(cells, x, ["i"], ["j"])
        return contract(cells, inner, ["j"], ["i"])

    x, _ = linalg.power_steps(squared, cells.select("i").distinct().withColumn("v", F.lit(1.0)), 2)
    return x.withColumn("v", F.round("v", 6))


@query("l7_top_eigen", "WITH g AS (SELECT a.j AS i, b.j AS j, sum(a.v * b.v) AS v FROM vectors a JOIN vectors b ON a.i = b.i GROUP BY 1, 2) SELECT CAST(sqrt(count(*)) AS BIGINT) AS n, round(sum(CASE WHEN i = j THEN v ELSE 0 END), 4) AS trace, round(sum(v * v), 3) AS squares, 0.0 AS residual FROM g", "vectors")
def _(t):
    """Count, sum and sum of squares of all values, and the largest part of ``M x - l x`` over all pairs."""
    g = linalg.gram_of_arrays(t.embeddings, "embedding").checkpoint()

    def product(x):
        return contract(g, x.withColumnRenamed("i", "j"), ["j"], ["i", "k"])

    start = g.select("i").distinct().select("i", F.lit(0).cast("bigint").alias("k"), F.lit(1.0).alias("v"))
    values, vectors = linalg.top_eigen(product, start, 256)
    own = vectors.join(values.select(F.col("pos").alias("k"), F.col("re").alias("l")), "k").select("i", "k", (F.col("l") * F.col("re")).alias("v"))
    off = sub(product(vectors.select("i", "k", F.col("re").alias("v"))), own, ["i", "k"]).agg((F.round(F.max(F.abs("v")), 6) + 0.0).alias("residual"))
    sums = values.agg(F.count("*").alias("n"), F.round(F.sum("re"), 4).alias("trace"), F.round(F.sum(F.col("re") * F.col("re")), 3).alias("squares"))
    return sums.crossJoin(off)


_BY_REGION = "own AS (SELECT row_sector AS sector, i, j, v FROM sectored), x(step, sector, j, v) AS (SELECT 0, sector, j, 1.0::DOUBLE FROM (SELECT DISTINCT sector, j FROM own) UNION ALL SELECT step + 1, sector, j, v / sqrt(sum(v * v) OVER (PARTITION BY sector)) FROM (SELECT any_value(step) AS step, q.sector, q.j, sum(q.v * y.v) AS v FROM own q JOIN (SELECT any_value(step) AS step, q.sector, q.i, sum(q.v * x.v) AS v FROM own q JOIN x ON q.sector = x.sector AND q.j = x.j WHERE x.step < 60 GROUP BY q.sector, q.i) y ON q.sector = y.sector AND q.i = y.i GROUP BY q.sector, q.j))"


@query("l7_by_sector", f"WITH RECURSIVE {_BY_REGION} SELECT sector, CAST(2 AS BIGINT) AS n, round(sum(v * v), 2) AS least, round(sum(v * v), 2) AS largest, 0.0 AS residual FROM (SELECT q.sector, q.i, sum(q.v * x.v) AS v FROM own q JOIN x ON q.sector = x.sector AND q.j = x.j WHERE x.step = 60 GROUP BY q.sector, q.i) GROUP BY sector", "sectored")
def _(t):
    """Of ``M^T M`` for the suppliers of each region, on two copies of the parts, so that each value is there twice; more
    indices than parts. The two largest, and the residual over them."""
    own = t.sectored().select(F.col("row_sector").alias("sector"), "i", "j", "v")
    cells = Blocks(cut(own), rows=(1 << 14, 1 << 16))
    flipped = cells.flipped()

    def doubled(x):
        # Of each index's two lines one is made, of twice the columns.
        inner = cells.times(reindexed(x, lambda i: i[::2] // 2))
        outer = flipped.times(summed(inner, flipped.tasks[1]))
        return reindexed(outer, lambda i: np.repeat(2 * i, 2) + np.tile([0, 1], len(i)))

    index = reindexed(cells.index(), lambda i: np.repeat(2 * i, 2) + np.tile([0, 1], len(i)))
    values, _ = linalg.top_eigen(doubled, index, 2, basis=16)
    return values.groupBy("sector").agg(F.count("*").alias("n"), F.round(F.min("re"), 2).alias("least"), F.round(F.max("re"), 2).alias("largest"), (F.round(F.max(F.col("residual") / F.col("re")), 6) + 0.0).alias("residual"))


_RIGHT_SIDES = "SELECT sector, j AS i, round(sum(v), 5) + 0.0 AS v FROM vectors GROUP BY 1, 2"


@query("l8_solve_systems", _RIGHT_SIDES, "vectors")
def _(t):
    """``A x`` for the solutions of each label's system, which is its right side: its Gram matrix, with 1 more on the diagonal."""
    g = _gram_by_label(t).withColumn("v", F.col("v") + (F.col("i") == F.col("j")).cast("double")).checkpoint()
    b = t.vectors().groupBy("sector", F.col("j").alias("i")).agg(F.sum("v").alias("v"))
    x = solve(g, b, "sector")
    back = g.join(x.select("sector", F.col("i").alias("j"), F.col("v").alias("_x")), ["sector", "j"])
    return back.groupBy("sector", "i").agg((F.round(F.sum(F.col("v") * F.col("_x")), 5) + 0.0).alias("v"))


@query("l8_solve_by_group", "SELECT l_returnflag, l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1, 2")
def _(t):
    out = linalg.solve_by_group(t.lineitem, ["l_returnflag", "l_linestatus"], ["l_quantity"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", F.round(F.col("coef")[0], 4).alias("slope"), F.round(F.col("coef")[1], 2).alias("intercept"))


@query("l9_pinv_fit", "SELECT j, round(sum(v * CAST(sector AS DOUBLE)), 4) + 0.0 AS v FROM vectors GROUP BY 1", "vectors")
def _(t):
    """The fit's normal equations: ``M^T M x``, which is ``M^T b``."""
    cells = t.vectors().select("i", "j", "v")
    b = t.embeddings.select(F.col("vec_id").alias("i"), F.col("label").cast("double").alias("v"))
    fitted = contract(cells, linalg.pinv_fit(cells, b), ["j"], ["i"])
    return contract(cells, fitted, ["i"], ["j"]).select("j", (F.round("v", 4) + 0.0).alias("v"))


@query(
    "l10_expm_apply",
    "WITH p AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS v FROM moves), x0 AS (SELECT DISTINCT i, 1.0 + length(i) AS v FROM moves), x1 AS (SELECT p.i, 0.3 * sum(p.v * x0.v) AS v FROM p JOIN x0 ON p.j = x0.i GROUP BY 1), x2 AS (SELECT p.i, 0.15 * sum(p.v * x1.v) AS v FROM p JOIN x1 ON p.j = x1.i GROUP BY 1), x3 AS (SELECT p.i, 0.1 * sum(p.v * x2.v) AS v FROM p JOIN x2 ON p.j = x2.i GROUP BY 1) SELECT i, round(sum(v), 6) AS v FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x3) GROUP BY 1",
    "moves",
)
def _(t):
    moves = linalg.transitions(t.events, "user_id", "event_type", ["ts", "event_id"])
    x = moves.select("i").distinct().withColumn("v", 1.0 + F.length("i"))
    return linalg.expm_apply(moves, x, 0.3, 3).withColumn("v", F.round("v", 6))


@query("l11_transitions", "SELECT i, j, n, round(n / sum(n) OVER (PARTITION BY i), 6) AS v FROM moves", "moves")
def _(t):
    return linalg.transitions(t.events, "user_id", "event_type", ["ts", "event_id"]).withColumn("v", F.round("v", 6))


def _spectrum(t):
    return linalg.transition_spectrum(linalg.transitions(t.events, "user_id", "event_type", ["ts", "event_id"]), linalg.SMALL_SIDE)


@query("l11_transition_spectrum", "WITH p AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS v FROM moves) SELECT round(sum(CASE WHEN a.i = a.j THEN a.v ELSE 0 END), 6) + 0.0 AS trace, round(sum(a.v * b.v), 6) + 0.0 AS of_two_moves FROM p a LEFT JOIN p b ON a.i = b.j AND a.j = b.i", "moves")
def _(t):
    """Sums of the values (the first is 1) and of their squares, which are the traces of one move and of two."""
    re, im = F.col("re"), F.col("im")
    return _spectrum(t).agg((F.round(F.sum(re), 6) + 0.0).alias("trace"), (F.round(F.sum(re * re - im * im), 6) + 0.0).alias("of_two_moves"))


@query(
    "l12_mixing_length",
    # The moves' matrix less its first value's part, squared 24 times: its norm grows by the second value.
    "WITH RECURSIVE names AS (SELECT i FROM moves UNION SELECT j FROM moves), p AS (SELECT a.i, b.i AS j, coalesce(m.n / sum(m.n) OVER (PARTITION BY a.i), 0.0::DOUBLE) - 1.0::DOUBLE / count(*) OVER (PARTITION BY a.i) AS v FROM names a CROSS JOIN names b LEFT JOIN moves m ON m.i = a.i AND m.j = b.i), r(step, i, j, v, s) AS (SELECT 0, i, j, v / sqrt(sum(v * v) OVER ()), ln(sqrt(sum(v * v) OVER ())) FROM p UNION ALL SELECT step + 1, i, j, v / sqrt(sum(v * v) OVER ()), 2 * s + ln(sqrt(sum(v * v) OVER ())) FROM (SELECT a.step, a.i, b.j, any_value(a.s) AS s, sum(a.v * b.v) AS v FROM r a JOIN r b ON a.j = b.i WHERE a.step < 24 GROUP BY a.step, a.i, b.j)) SELECT round(-1 / (max(s) / pow(2, 24)), 4) AS length FROM r WHERE step = 24",
    "moves",
)
def _(t):
    return linalg.mixing_length(_spectrum(t)).withColumn("length", F.round("length", 4))


@query("l13_two_sided_projectors", "SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM vectors a JOIN vectors b ON a.i = b.i WHERE a.j < 20 AND b.j >= 20 GROUP BY 1, 2", "vectors")
def _(t):
    """With all directions kept, ``(R^T P) (Rt^T Pt)^T`` is ``R^T Rt``."""
    own = t.vectors()
    # One matrix, not one for each label: sectors would share the 20 directions.
    left, right = (own.where(c).select("i", "j", "v") for c in ("j < 20", "j >= 20"))
    p, pt = linalg.two_sided_projectors(left, right, 20)
    a = contract(left, p.withColumnRenamed("j", "k"), ["i"], ["j", "k"])
    b = contract(right.withColumnRenamed("j", "j2"), pt.withColumnRenamed("j", "k"), ["i"], ["j2", "k"])
    return contract(a, b, ["k"], ["j", "j2"]).select(F.col("j").alias("i"), F.col("j2").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


@query("l13_projectors_by_sector", "SELECT a.sector AS sector, a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) + 0.0 AS v FROM vectors a JOIN vectors b ON a.i = b.i WHERE a.j < 20 AND b.j >= 20 GROUP BY 1, 2, 3", "vectors")
def _(t):
    """The same in each sector, all cut at once."""
    own = t.vectors()
    left, right = (own.where(c).select("sector", "i", "j", "v") for c in ("j < 20", "j >= 20"))
    p, pt = linalg.two_sided_projectors(left, right, 1 << 40, rtol=0.0)
    a = contract(left, p.withColumnRenamed("j", "k"), ["sector", "i"], ["sector", "j", "k"])
    b = contract(right.withColumnRenamed("j", "j2"), pt.withColumnRenamed("j", "k"), ["sector", "i"], ["sector", "j2", "k"])
    return contract(a, b, ["sector", "k"], ["sector", "j", "j2"]).select("sector", F.col("j").alias("i"), F.col("j2").alias("j"), (F.round("v", 6) + 0.0).alias("v"))


@query("l3_gram_norm", "SELECT sector, round(sqrt(sum(v * v)), 6) AS norm FROM (SELECT a.sector, a.j AS p, b.j AS q, sum(a.v * b.v) AS v FROM vectors a JOIN vectors b ON a.i = b.i GROUP BY 1, 2, 3) GROUP BY 1", "vectors")
def _(t):
    return aggregates.norm(_gram_by_label(t), ["sector"]).withColumn("norm", F.round("norm", 6))
