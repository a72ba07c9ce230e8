"""Ranked truncation that never splits ties, positions, codes and expansions."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Distinct values that one ordered pass takes, at most; more raises.
PASS_VALUES = 1_000_000


#: Quantiles by which one round of a cut's search divides what is left.
QUANTILES = 128


def bucket(value: Column, edges: Sequence[float], low: int = 0, high: int | None = None) -> Column:
    """How many of the ascending edges are under a value, by halving."""
    high = len(edges) if high is None else high
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value <= F.lit(edges[middle]), bucket(value, edges, low, middle)).otherwise(bucket(value, edges, middle + 1, high))


def cut_value(weights: DataFrame, target: float) -> float | None:
    """The least value of ``v, dim`` over which the dimensions sum to less than the target: what a cut keeps begins there.

    Nothing is put in order: each round sums the dimensions between quantiles of what is left, and goes on with the one
    interval in which the target is met. The driver sees a sum for each interval. Rounds are the logarithm of the number
    of rows to the base of QUANTILES; rows of equal values count as one.
    """
    v, above, own = F.col("v").cast("double"), 0.0, weights
    while True:
        shares = [k / QUANTILES for k in range(1, QUANTILES)]
        low, high, inner = own.agg(F.min(v), F.max(v), F.percentile_approx(v, shares, 8 * QUANTILES)).head()
        if low is None or low == high:
            return low
        # Quantiles are intervals of their own, so that what is left shrinks however values repeat.
        edges = sorted({low, *(y for x in (high, *inner) for y in (x, math.nextafter(x, -math.inf)) if y >= low)})
        sums = {r["_b"]: (r["_d"], r["_low"]) for r in own.groupBy(bucket(v, edges).alias("_b")).agg(F.sum("dim").alias("_d"), F.min(v).alias("_low")).collect()}
        for b in sorted(sums, reverse=True):
            if above + sums[b][0] >= target:
                break
            above += sums[b][0]
        else:
            return low
        if sums[b][1] == edges[b]:  # the interval ends with its own least value
            return edges[b]
        own = own.where((v > edges[b - 1]) & (v <= edges[b]))


def cut_multiplets(weights: DataFrame, target: int, atol: float = 0.0, rtol: float | None = None, ratio: float = 1.0) -> DataFrame:
    """The largest weights of all sectors until their dimensions reach the target, ties kept together.

    Values are taken in groups: the largest left leads, and all that are at least ``ratio`` times
    it go with it. A group starts only if its leader is over the cutoff, ``atol + rtol * max``
    (``rtol`` is by default the number of values times the machine's epsilon), and under the
    target so far; so the result may exceed it. Returns the kept rows. An empty table stays
    empty; null values are never kept; NaN raises.

    The cut is a value, found without an order over all (see :func:`cut_value`), so that any number of rows may be kept.
    With a ratio under 1, the distinct values down to ``ratio`` times that value are put in groups in one pass, which
    takes up to PASS_VALUES. Weights are written once and read again by each round. Runs small jobs at once.
    """
    weights = cut(weights)
    top = weights.agg(F.max("v"), F.count("v"), F.count_if(F.isnan(F.col("v").cast("double")))).head()
    if top[2]:
        raise ValueError(f"{top[2]} weights are no numbers")
    if not top[1] or target <= 0:
        return weights.limit(0)
    cutoff = atol + (top[1] * sys.float_info.epsilon if rtol is None else rtol) * top[0]
    over = weights.where(F.col("v") > cutoff)
    limit = cut_value(over.select("v", "dim"), target)
    if limit is None:
        return weights.limit(0)
    if ratio == 1.0:
        return over.where(F.col("v").cast("double") >= limit)
    # A leader's dimensions above are those of all larger values, so leaders are at least the cut of exact ties.
    values = weights.where((F.col("v").cast("double") >= min(limit, ratio * limit)) & (F.col("v") > min(cutoff, ratio * cutoff)))
    near = values.groupBy("v").agg(F.sum("dim").alias("dim"))
    if near.count() > PASS_VALUES:
        raise ValueError(f"over {PASS_VALUES} distinct values near the cut")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        kept, leader, count = [], None, 0
        for v, dim in rows.sort_values("v", ascending=False)[["v", "dim"]].itertuples(index=False):
            if leader is None or v < ratio * leader:
                if not (v > cutoff and count < target):
                    break
                leader = v
            kept.append(v)
            count += dim
        return pd.DataFrame({"v": pd.Series(kept, dtype="float64")})

    kept = near.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(run, "v double")
    return weights.join(kept, "v").select(*weights.columns)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """``rows`` with ``begin``, ``rank`` (from 0) and ``total``: each row's place in its group by an order, of ties any,
    and the group's size. ``begin`` is the number of rows in groups before, so it tells groups apart.

    Rows are dealt by range and sorted, and ``keep`` writes them; no task orders more than a range, however large a
    group is. What is summed in one task is one count for each of the write's tasks. Null values come first. Runs at once.
    """
    keys = [*by, *order]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    own = keep(sorted_).withColumn("_part", F.shiftright("_at", 33))  # the upper bits tell the task that wrote the row
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    if not by:
        total = own.agg(F.count("*").alias("total"))
        return own.join(parts, "_part").crossJoin(F.broadcast(total)).select(*rows.columns, F.lit(0).cast("bigint").alias("begin"), place.alias("rank"), "total")  # one row
    names = {f"_k{k}": F.col(c) for k, c in enumerate(by)}
    pieces = own.groupBy("_part", *[c.alias(k) for k, c in names.items()]).agg(F.count("*").alias("_rows"), F.min("_at").alias("_at")).join(parts, "_part")
    groups = pieces.groupBy(*names).agg(F.min(place).alias("begin"), F.sum("_rows").alias("total"))
    # A part's rows meet their group by part, so that a group of any size is no single key.
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"g.{k}")) for k in names]
    told = pieces.alias("p").join(groups.alias("g"), reduce(and_, same)).select(F.col("_part").alias("_p"), *[F.col(f"p.{k}").alias(k) for k in names], "_before", "begin", "total")
    here = [F.col("_part") == F.col("_p"), *[c.eqNullSafe(F.col(k)) for k, c in names.items()]]
    return own.join(told, reduce(and_, here)).select(*rows.columns, "begin", (place - F.col("begin")).alias("rank"), "total")


def cuts(kept: DataFrame) -> DataFrame:
    """``sector, cut``: how many values of each sector were kept."""
    return kept.groupBy("sector").agg(F.count("*").alias("cut"))


def ranked(weights: DataFrame, name: str = "rank") -> DataFrame:
    """Each value's place in its sector by magnitude, from 0, ties by position."""
    place = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc(F.abs("v")), "pos")) - 1
    return weights.withColumn(name, place.cast("bigint"))


def topk_by_magnitude(weights: DataFrame, k: int) -> DataFrame:
    """The k values of each sector of largest magnitude, ties by position."""
    place = F.row_number().over(Window.partitionBy("sector").orderBy(F.desc(F.abs("v")), "pos"))
    return weights.withColumn("_k", place).where(F.col("_k") <= k).drop("_k")


def apply_cut(cells: DataFrame, cut: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows whose position is under their sector's cut; sectors without one vanish."""
    return cells.join(cut.select("sector", "cut"), "sector").where(F.col(pos) < F.col("cut")).select(*cells.columns)


def expand_multiplicity(weights: DataFrame, sort: bool = False) -> DataFrame:
    """Each value as often as its dimension says, by decreasing magnitude if asked for."""
    rows = weights.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("dim").cast("int")))).where("dim > 0")
    return rows.orderBy(F.desc(F.abs("v")), "sector", "pos", "copy") if sort else rows


def position_in_sector(catalog: DataFrame, sector: str = "q", by: Sequence[str] = ("leg",)) -> DataFrame:
    """Each index's place among those of its leg and charge, from 0. A charge of any number of indices is no single
    task's (see :func:`numbered`, which runs at once)."""
    return numbered(catalog, [*by, sector], ["idx"]).withColumnRenamed("rank", "pos").drop("begin", "total")


def encode_first_seen(df: DataFrame, column: str, order: Column | str) -> DataFrame:
    """``value, first, code``: dense codes in the order in which values first appear, of any number of values
    (see :func:`numbered`, which runs at once)."""
    first = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    return numbered(first, [], ["first", "value"]).select("value", "first", F.col("rank").cast("int").alias("code"))


#: Indices of one key that one task makes, at most.
RUN = 1 << 16


def catalog_from_hist(hist: DataFrame, leg: int = 0) -> DataFrame:
    """``leg, idx, q``: one row for each counted index, by key. Only distinct keys are ordered in one task; a key's
    indices are made in runs of a bounded length, dealt to all tasks."""
    before = F.coalesce(F.sum("n").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n, zero = F.col("n").cast("bigint"), F.lit(0).cast("bigint")
    runs = hist.where("n > 0").withColumn("_from", before).withColumn("_run", F.explode(F.sequence(zero, F.floor((n - 1) / RUN).cast("bigint"))))
    place = F.explode(F.sequence(zero, F.least(F.lit(RUN).cast("bigint"), n - F.col("_run") * RUN) - 1))
    rows = runs.repartition("key", "_run").withColumn("_k", place)
    return rows.select(F.lit(leg).alias("leg"), (F.col("_from") + F.col("_run") * RUN + F.col("_k")).cast("bigint").alias("idx"), F.col("key").cast("int").alias("q"))


def hist_from_catalog(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(F.col("q").alias("key")).agg(F.count("*").alias("n"))


def singlet(spark) -> DataFrame:
    """The neutral leg's histogram: one index of charge 0."""
    return spark.createDataFrame([(0, 1)], "key int, n bigint")


