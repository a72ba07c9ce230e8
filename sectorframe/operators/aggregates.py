"""Norms, traces, marginals, entropies and statistics: sums that combine partially before any shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import Rule, dagger, rule
from .joins import sub


def norm(cells: DataFrame, by: Sequence[str] = (), dim: str | None = None) -> DataFrame:
    """Square root of the sum of squares, each times its sector's dimension if there is such a column."""
    factor = F.col(dim) if dim else F.lit(1.0)
    return cells.groupBy(*by).agg(F.sqrt(F.coalesce(F.sum(factor * F.col("v") * F.col("v")), F.lit(0.0))).alias("norm"))


def trace(cells: DataFrame, by: Sequence[str] = (), dim: str | None = None, row: str = "i", col: str = "j") -> DataFrame:
    factor = F.col(dim) if dim else F.lit(1.0)
    return cells.where(F.col(row) == F.col(col)).groupBy(*by).agg(F.coalesce(F.sum(factor * F.col("v")), F.lit(0.0)).alias("trace"))


def partial_trace(cells: DataFrame, keep: Sequence[str], traced: Sequence[tuple[str, str]]) -> DataFrame:
    """The diagonal of the traced pairs of legs summed for each combination of the others, over the total trace.

    ``keep`` lists rows then columns, in equal numbers. Raises if the trace is 0. Runs a sum at once.
    """
    own = cells
    for a, b in traced:
        own = own.where(F.col(a) == F.col(b))
    own = own.groupBy(*keep).agg(F.sum("v").alias("v"))
    half = len(keep) // 2
    diagonal = own
    for a, b in zip(keep[:half], keep[half:], strict=True):
        diagonal = diagonal.where(F.col(a) == F.col(b))
    total = diagonal.agg(F.sum("v")).head()[0]
    if not total:
        raise ZeroDivisionError("the trace is 0")
    return own.withColumn("v", F.col("v") / F.lit(float(total)))


def hist_convolve(a: DataFrame, b: DataFrame, by: str | Rule = "additive") -> DataFrame:
    """Histogram of the key of pairs of independent keys: ``n`` sums ``n1 * n2`` over pairs of keys.

    Both histograms are aggregated first, so the pairs are of distinct keys, never of indices.
    """
    one, two = (h.groupBy("key").agg(F.sum("n").alias("n")) for h in (a, b))
    pairs = one.toDF("k1", "n1").crossJoin(two.toDF("k2", "n2"))
    return pairs.groupBy(rule(by)(F.col("k1") + F.col("k2")).cast("int").alias("key")).agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))


def block_sizes(rows: Sequence[DataFrame], cols: Sequence[DataFrame], by: str | Rule = "additive") -> DataFrame:
    """``sector, n_rows, n_cols`` of each sector that both sides have, from the histograms of their legs."""
    sides = []
    for hists in (rows, cols):
        out = hists[0].groupBy(rule(by)(F.col("key")).cast("int").alias("key")).agg(F.sum("n").alias("n"))
        for h in hists[1:]:
            out = hist_convolve(out, h, by)
        sides.append(out)
    return sides[0].toDF("sector", "n_rows").join(sides[1].toDF("sector", "n_cols"), "sector")


def hist_stats(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total dimension ``sum(n * key)``, number of keys, largest key, whether any key is odd or even."""
    return hist.groupBy(*by).agg(
        F.sum(F.col("n") * F.col("key")).alias("total_dim"),
        F.count("*").alias("n_keys"),
        F.max("key").alias("max_key"),
        F.bool_or(F.pmod("key", F.lit(2)) == 1).alias("any_odd"),
        F.bool_or(F.pmod("key", F.lit(2)) == 0).alias("any_even"),
    )


def hist_multiplicity(hist: DataFrame, keys: DataFrame) -> DataFrame:
    """``key, n`` for each key asked for, 0 where the histogram lacks it."""
    return keys.select("key").join(hist.select("key", "n"), "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def hist_truncate(hist: DataFrame, max_key: int) -> DataFrame:
    return hist.where(F.col("key") <= max_key)


def entropy(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``-sum(p ln p)`` of each group's values, each counted ``dim`` times and all normalised to sum 1.

    Written with the sums of ``v`` and ``v ln v``, so no group is read twice. Zero values add
    nothing. A negative value gives NaN.
    """
    v, dim = F.col("v"), F.col("dim")
    total, logs = F.sum(dim * v), F.sum(F.when(v == 0, 0.0).when(v < 0, float("nan")).otherwise(dim * v * F.ln(F.abs(v))))
    return weights.groupBy(*by).agg(F.when(total != 0, F.ln(total) - logs / total).alias("entropy"))


def normalise(cells: DataFrame) -> tuple[DataFrame, float]:
    """Cells over their norm, and the logarithm of the factor, to be summed up by the caller. Runs the norm at once."""
    import math

    size = norm(cells).head().norm
    if not size:
        raise ZeroDivisionError("the norm is 0")
    return cells.withColumn("v", F.col("v") / F.lit(size)), math.log(size)


def signed_log_product(df: DataFrame, by: Sequence[str] = (), x: str = "x", e: str = "e") -> DataFrame:
    """``log_product``: the sum of ``e ln|x|``, and ``mean_log``, over the number of factors.

    NaN where the product is negative. A zero factor gives minus infinity, with exponent -1
    plus infinity, and both kinds NaN.
    """
    v, sign = F.col(x), F.col(e)
    logs = F.sum(F.when(v != 0, sign * F.ln(F.abs(v))).otherwise(0.0))
    negative = F.pmod(F.sum(F.when(v < 0, 1).otherwise(0)), F.lit(2)) == 1
    down, up = F.coalesce(F.bool_or((v == 0) & (sign > 0)), F.lit(False)), F.coalesce(F.bool_or((v == 0) & (sign < 0)), F.lit(False))
    total = F.when(down & up, float("nan")).when(down, float("-inf")).when(up, float("inf")).when(negative, float("nan")).otherwise(logs)
    return df.groupBy(*by).agg(total.alias("log_product"), (total / F.count("*")).alias("mean_log"))


def weights_summary(weights: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum, norm and length of weights with their multiplicities."""
    v, dim = F.col("v"), F.col("dim")
    return weights.groupBy(*by).agg(F.sum(dim * v).alias("total"), F.sqrt(F.sum(dim * v * v)).alias("norm"), F.sum(dim).cast("bigint").alias("length"))


def tensor_stats(cells: DataFrame, legs: Sequence[str] = ("i", "j")) -> DataFrame:
    """Stored coefficients, sectors, and of each leg its distinct, least and greatest indices."""
    each: list[Column] = []
    for leg in legs:
        each += [F.count_distinct(leg).alias(f"n_{leg}"), F.min(leg).alias(f"min_{leg}"), F.max(leg).alias(f"max_{leg}")]
    return cells.agg(F.count("*").alias("n_cells"), F.count_distinct("sector").alias("n_sectors"), *each)


def distinct_hists(hists: DataFrame, by: str) -> DataFrame:
    """``total_dim, hist`` of the distinct histograms of a collection, by dimension and content.

    A histogram's distinct keys are the bound of a group.
    """
    ordered = F.sort_array(F.collect_list(F.struct("key", "n")))
    canonical = hists.groupBy(by).agg(F.sum(F.col("n") * F.col("key")).alias("total_dim"), ordered.alias("_h"))
    text = F.array_join(F.transform("_h", lambda x: F.concat_ws("*", x["n"].cast("string"), x["key"].cast("string"))), " + ")
    return canonical.select("total_dim", text.alias("hist")).distinct().orderBy("total_dim", "hist")


def asymmetry(cells: DataFrame) -> DataFrame:
    """Norm of the difference of cells and their adjoint."""
    own = cells.select("i", "j", "v")
    return norm(sub(own, dagger(own))).withColumnRenamed("norm", "asymmetry")
