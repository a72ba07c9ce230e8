"""Queries of aggregations, ranking and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates, ranking, validation
from ..operators.joins import add
from ..operators.lineage import cut
from .registry import query


@query("d1_norm", "SELECT sector, round(sqrt(sum((sector + 1) * v * v)), 6) AS norm FROM blocks GROUP BY 1", "blocks")
def _(t):
    own = t.blocks().withColumn("dim", F.col("sector") + 1)
    return aggregates.norm(own, ["sector"], "dim").withColumn("norm", F.round("norm", 6))


@query("d2_trace", "SELECT sector, sum((sector + 1) * v) AS trace FROM blocks WHERE i = j GROUP BY 1", "blocks")
def _(t):
    own = t.blocks().withColumn("dim", F.col("sector") + 1)
    return aggregates.trace(own, ["sector"], "dim")


@query("d3_partial_trace", "WITH m AS (SELECT l_suppkey % 3 AS a, l_partkey % 4 AS b, l_orderkey % 3 AS c, l_orderkey % 4 AS d, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4), s AS (SELECT a, c, sum(v) AS v FROM m WHERE b = d GROUP BY 1, 2) SELECT a, c, round(v / (SELECT sum(v) FROM s WHERE a = c), 6) AS v FROM s")
def _(t):
    from ..sources.cells import cells_from_facts

    legs = {"a": F.col("l_suppkey") % 3, "b": F.col("l_partkey") % 4, "c": F.col("l_orderkey") % 3, "d": F.col("l_orderkey") % 4}
    cells = cells_from_facts(t.lineitem, legs, "l_quantity")
    return aggregates.partial_trace(cells, ["a", "c"], [("b", "d")]).withColumn("v", F.round("v", 6))


@query("d4_block_sizes", "WITH r AS (SELECT n_regionkey AS sector, count(*) AS n_rows FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), c AS (SELECT (a.key + b.key) % 5 AS sector, CAST(sum(a.n * b.n) AS BIGINT) AS n_cols FROM quantity_hist a CROSS JOIN size_hist b GROUP BY 1) SELECT CAST(sector AS INTEGER) AS sector, n_rows, n_cols FROM r JOIN c USING (sector)", "quantity_hist size_hist")
def _(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("key")).agg(F.count("*").alias("n"))
    return aggregates.block_sizes([rows], [t.quantity_hist(), t.size_hist()], "mod 5")


@query("d5_hist_convolve", "SELECT a.key + b.key AS key, CAST(sum(a.n * b.n) AS BIGINT) AS n FROM quantity_hist a CROSS JOIN size_hist b GROUP BY 1", "quantity_hist size_hist")
def _(t):
    return aggregates.hist_convolve(t.quantity_hist(), t.size_hist())


@query("d6_hist_stats", "SELECT CAST(sum(n * key) AS BIGINT) AS total_dim, count(*) AS n_keys, max(key) AS max_key, bool_or(key % 2 = 1) AS any_odd, bool_or(key % 2 = 0) AS any_even FROM quantity_hist", "quantity_hist")
def _(t):
    return aggregates.hist_stats(t.quantity_hist())


@query("d6_hist_multiplicity", "SELECT n_nationkey AS key, coalesce(n, 0) AS n FROM nation LEFT JOIN size_hist ON key = n_nationkey", "size_hist")
def _(t):
    return aggregates.hist_multiplicity(t.size_hist(), t.nation.select(F.col("n_nationkey").alias("key")))


@query("d7_hist_truncate", "SELECT key, n FROM quantity_hist WHERE key <= 20", "quantity_hist")
def _(t):
    return aggregates.hist_truncate(t.quantity_hist(), 20)


@query("d8_entropy", "WITH s AS (SELECT sector, sum(dim * v) AS total FROM weights GROUP BY 1) SELECT sector, round(-sum(dim * (v / total) * ln(v / total)), 6) AS entropy FROM weights JOIN s USING (sector) WHERE v > 0 GROUP BY 1", "weights")
def _(t):
    return aggregates.entropy(t.customer_weights(), ["sector"]).withColumn("entropy", F.round("entropy", 6))


@query("d9_normalise", "SELECT i, j, round(v / (SELECT sqrt(sum(v * v)) FROM quantity), 9) AS v, (SELECT round(ln(sqrt(sum(v * v))), 6) FROM quantity) AS log_norm FROM quantity", "quantity")
def _(t):
    cells, log = aggregates.normalise(t.quantity())
    return cells.withColumn("v", F.round("v", 9)).withColumn("log_norm", F.round(F.lit(log), 6))


@query("d10_signed_log_product", "WITH f AS (SELECT n_regionkey AS g, c_nationkey % 2 AS half, c_acctbal AS x, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END AS e FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT g, half, CASE WHEN sum(CASE WHEN x < 0 THEN 1 ELSE 0 END) % 2 = 1 THEN 'NaN' ELSE CAST(round(sum(e * ln(abs(x))), 4) AS DECIMAL(20, 4))::VARCHAR END AS log_product FROM f GROUP BY 1, 2")
def _(t):
    own = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("g"), (F.col("c_nationkey") % 2).alias("half"), F.col("c_acctbal").alias("x"), F.when(F.col("c_custkey") % 2 == 0, 1).otherwise(-1).alias("e"))
    out = aggregates.signed_log_product(own, ["g", "half"])
    text = F.when(F.isnan("log_product"), "NaN").otherwise(F.round("log_product", 4).cast("decimal(20,4)").cast("string"))
    return out.select("g", "half", text.alias("log_product"))


@query("d11_weights_summary", "SELECT sector, sum(dim * v) AS total, round(sqrt(sum(dim * v * v)), 6) AS norm, CAST(sum(dim) AS BIGINT) AS length FROM weights GROUP BY 1", "weights")
def _(t):
    return aggregates.weights_summary(t.customer_weights(), ["sector"]).withColumn("norm", F.round("norm", 6))


@query("d12_tensor_stats", "SELECT count(*) AS n_cells, count(DISTINCT sector) AS n_sectors, count(DISTINCT i) AS n_i, min(i) AS min_i, max(i) AS max_i, count(DISTINCT j) AS n_j, min(j) AS min_j, max(j) AS max_j FROM blocks", "blocks")
def _(t):
    return aggregates.tensor_stats(t.blocks())


@query("d13_distinct_hists", "WITH h AS (SELECT l_suppkey AS g, l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT DISTINCT total_dim, hist FROM (SELECT g, CAST(sum(n * key) AS BIGINT) AS total_dim, string_agg(n || '*' || key, ' + ' ORDER BY key) AS hist FROM h GROUP BY 1)")
def _(t):
    hists = t.lineitem.groupBy(F.col("l_suppkey").alias("g"), F.col("l_linenumber").alias("key")).agg(F.count("*").alias("n"))
    return aggregates.distinct_hists(hists, "g")


@query("d14_asymmetry", "SELECT round(sqrt(sum(v * v)), 6) AS asymmetry FROM (SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM quantity UNION ALL SELECT j, i, 0.0 - v FROM quantity) GROUP BY 1, 2)", "quantity")
def _(t):
    return aggregates.asymmetry(t.quantity()).withColumn("asymmetry", F.round("asymmetry", 6))


@query("r1_cut_multiplets", "SELECT sector, pos, dim, v FROM weights JOIN (SELECT v, sum(sum(dim)) OVER (ORDER BY v DESC) - sum(dim) AS above FROM weights GROUP BY v) USING (v) WHERE above < 300 AND v > (SELECT count(*) * 2.220446049250313e-16 * max(v) FROM weights)", "weights")
def _(t):
    return ranking.cut_multiplets(t.customer_weights(), 300)


@query("r1_cuts", "SELECT sector, count(*) AS cut FROM weights JOIN (SELECT v, sum(sum(dim)) OVER (ORDER BY v DESC) - sum(dim) AS above FROM weights GROUP BY v) USING (v) WHERE above < 300 AND v > 10.0 + 0.5 * (SELECT max(v) FROM weights) GROUP BY 1", "weights")
def _(t):
    return ranking.cuts(ranking.cut_multiplets(t.customer_weights(), 300, atol=10.0, rtol=0.5))


@query(
    "r2_cut_near_ties",
    """WITH RECURSIVE d AS (SELECT v, CAST(sum(dim) AS BIGINT) AS dim FROM weights GROUP BY v),
c AS (SELECT (SELECT count(*) FROM weights) * 2.220446049250313e-16 * max(v) AS cutoff FROM d),
g AS (SELECT max(v) AS leader, CAST(0 AS BIGINT) AS before FROM d
UNION ALL SELECT (SELECT max(v) FROM d WHERE v < 0.97 * g.leader), g.before + (SELECT sum(dim) FROM d WHERE v <= g.leader AND v >= 0.97 * g.leader) FROM g WHERE g.leader IS NOT NULL AND g.before < 300),
k AS (SELECT leader FROM g, c WHERE leader > cutoff AND before < 300)
SELECT sector, pos, dim, v FROM weights WHERE EXISTS (SELECT 1 FROM k WHERE v <= leader AND v >= 0.97 * leader)""",
    "weights",
)
def _(t):
    return ranking.cut_multiplets(t.customer_weights(), 300, ratio=0.97)


@query("r3_topk_by_magnitude", "SELECT sector, pos, dim, v FROM (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY abs(v) DESC, pos) AS k FROM weights) WHERE k <= 3", "weights")
def _(t):
    return ranking.topk_by_magnitude(t.customer_weights(), 3)


@query("r4_apply_cut", "WITH r AS (SELECT sector, v, row_number() OVER (PARTITION BY sector ORDER BY abs(v) DESC, pos) - 1 AS pos FROM weights), c AS (SELECT sector, count(*) AS cut FROM weights JOIN (SELECT v, sum(sum(dim)) OVER (ORDER BY v DESC) - sum(dim) AS above FROM weights GROUP BY v) USING (v) WHERE above < 300 GROUP BY 1) SELECT sector, CAST(pos AS BIGINT) AS pos, v FROM r JOIN c USING (sector) WHERE pos < cut", "weights")
def _(t):
    own = cut(t.customer_weights())  # ranked and cut
    place = ranking.ranked(own, "rank").select("sector", F.col("rank").alias("pos"), "v")
    return ranking.apply_cut(place, ranking.cuts(ranking.cut_multiplets(own, 300)))


@query("r5_expand_multiplicity", "SELECT sector, pos, dim, v, CAST(unnest(range(1, dim + 1)) AS INTEGER) AS copy FROM weights", "weights")
def _(t):
    return ranking.expand_multiplicity(t.customer_weights(), sort=True)


@query("r6_position_in_sector", "SELECT leg, idx, q, CAST(row_number() OVER (PARTITION BY leg, q ORDER BY idx) - 1 AS BIGINT) AS pos FROM catalog", "catalog")
def _(t):
    return ranking.position_in_sector(t.catalog())


@query("r7_encode_first_seen", "SELECT event_type AS value, min(event_id) AS first, CAST(row_number() OVER (ORDER BY min(event_id)) - 1 AS INTEGER) AS code FROM events GROUP BY 1")
def _(t):
    return ranking.encode_first_seen(t.events, "event_type", "event_id")


@query("r8_catalog_from_hist", "SELECT 0 AS leg, CAST(row_number() OVER (ORDER BY p_size) - 1 AS BIGINT) AS idx, p_size AS q FROM part")
def _(t):
    return ranking.catalog_from_hist(t.size_hist())


@query("r8_hist_from_catalog", "SELECT q AS key, count(*) AS n FROM catalog GROUP BY 1", "catalog")
def _(t):
    return ranking.hist_from_catalog(t.catalog())


@query("v1_off_sector_mass", "SELECT sum(v * v) AS total, sum(CASE WHEN row_sector <> col_sector THEN v * v ELSE 0.0 END) AS lost, round(1 - sqrt(sum(CASE WHEN row_sector = col_sector THEN v * v ELSE 0.0 END) / sum(v * v)), 9) AS share, false AS ok FROM sectored", "sectored")
def _(t):
    return validation.off_sector_mass(t.sectored()).withColumn("share", F.round("share", 9))


@query("v2_check_bond_table", "WITH b AS (SELECT bond, count(*) AS n, max(times) AS most FROM (SELECT bond, tensor, count(*) AS times FROM bonds GROUP BY 1, 2) GROUP BY 1), s AS (SELECT bond, count(*) AS n FROM bonds GROUP BY 1) SELECT bond, n, 'count' AS problem FROM s WHERE n <> 2 UNION ALL SELECT bond, s.n, 'twice' FROM s JOIN b USING (bond) WHERE most > 1 UNION ALL SELECT k, 0, 'missing' FROM (SELECT unnest(range(0, (SELECT max(bond) + 1 FROM bonds))) AS k) WHERE k NOT IN (SELECT bond FROM bonds)", "bonds")
def _(t):
    return validation.check_bond_table(t.bonds())


@query("v3_check_square", "SELECT 0 AS leg, idx, q, 'left' AS side FROM (SELECT idx, q FROM catalog WHERE leg = 0 EXCEPT SELECT idx, q FROM catalog WHERE leg = 1) UNION ALL SELECT 0, idx, q, 'right' FROM (SELECT idx, q FROM catalog WHERE leg = 1 EXCEPT SELECT idx, q FROM catalog WHERE leg = 0)", "catalog")
def _(t):
    return validation.check_square(t.catalog(), [0], [1], [False, True])


@query("v4_layout_differences", "SELECT leg, idx, q, 'left' AS side FROM catalog WHERE q <> 0 UNION ALL SELECT leg, idx, -q, 'right' FROM catalog WHERE q <> 0", "catalog")
def _(t):
    from ..functions.keys import dual

    return validation.layout_differences(t.catalog(), dual(t.catalog()))


@query("v5_check_blocks", "SELECT i, j, 'sector' AS problem FROM sectored WHERE row_sector <> col_sector", "sectored")
def _(t):
    cells = t.sectored().select("i", "j", F.col("row_sector").alias("sector"))
    return validation.check_blocks(cells, t.side(0), t.side(1))


@query("v6_check_grid", "WITH k AS (SELECT CAST(p_size AS VARCHAR) AS label, CAST(min(p_partkey % 3) AS INTEGER) AS q, bool_or(p_size % 2 = 0) AS out FROM part GROUP BY 1) SELECT a.x, a.y, a.label, b.label AS neighbour, p.q, r.q AS other_q FROM grid a JOIN grid b ON b.x = (a.x + 1) % 40 AND b.y = a.y JOIN k p ON p.label = a.label JOIN k r ON r.label = b.label WHERE p.q <> r.q OR p.out = r.out", "grid")
def _(t):
    charges = t.part.groupBy(F.col("p_size").cast("string").alias("label")).agg(F.min(F.col("p_partkey") % 3).cast("int").alias("q"), F.bool_or(F.col("p_size") % 2 == 0).alias("out"))
    grid, size = t.grid()
    return validation.check_grid(grid, charges, 1, 0, size)


@query("v8_check_references", "WITH e AS (SELECT l_orderkey AS bond, min(l_suppkey) AS a, max(l_suppkey) AS b FROM lineitem GROUP BY 1), s AS (SELECT s_suppkey AS tensor FROM supplier WHERE s_suppkey % 10 <> 3), g AS (SELECT o_orderkey AS bond FROM orders WHERE o_orderkey % 4 <> 1), d AS (SELECT bond, a AS tensor FROM e UNION SELECT bond, b FROM e) SELECT DISTINCT tensor AS id, 'unknown tensor' AS problem FROM d WHERE tensor NOT IN (SELECT tensor FROM s) UNION SELECT bond, 'equal ends' FROM e WHERE a = b UNION SELECT tensor, 'unused tensor' FROM s WHERE tensor NOT IN (SELECT tensor FROM d) UNION SELECT bond, 'bond without gate' FROM e WHERE bond NOT IN (SELECT bond FROM g) UNION SELECT bond, 'gate without bond' FROM g WHERE bond NOT IN (SELECT bond FROM e)")
def _(t):
    edges = t.lineitem.groupBy(F.col("l_orderkey").alias("bond")).agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    tensors = t.supplier.where("s_suppkey % 10 <> 3").select(F.col("s_suppkey").alias("tensor"))
    return validation.check_references(edges, tensors, t.orders.where("o_orderkey % 4 <> 1").select(F.col("o_orderkey").alias("bond")))


@query("chained_marginal", "SELECT i, j, sum(v) AS v FROM (SELECT i, j, v FROM flag_a UNION ALL SELECT i, j, 2.0 * v FROM flag_r) GROUP BY 1, 2", "flag_a flag_r")
def _(t):
    from ..functions.keys import scale

    return add(t.flags("A"), scale(t.flags("R"), 2.0))
