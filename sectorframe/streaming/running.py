"""Sums of cells that arrive as a stream: the algebraic aggregates of batch tables, kept as state.

A cell that arrives twice is added twice, as the parts of one sum. So the linear sums (trace,
contraction with a table at rest, marginals) are exact at any time; squares need cells that
arrive whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_norm(stream: DataFrame, by: Sequence[str] = ("sector",)) -> DataFrame:
    """``n_cells, norm`` of the whole cells so far, for each group; use with output mode ``complete`` or ``update``."""
    return stream.groupBy(*by).agg(F.count("*").alias("n_cells"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))


def running_trace(stream: DataFrame, by: Sequence[str] = ("sector",)) -> DataFrame:
    return stream.where(F.col("i") == F.col("j")).groupBy(*by).agg(F.sum("v").alias("trace"))


def running_contract(stream: DataFrame, table: DataFrame, on: Sequence[str], free: Sequence[str]) -> DataFrame:
    """The contraction of a stream's cells with a table at rest: a stream-static join and a running sum."""
    joined = stream.withColumnRenamed("v", "_a").join(table.withColumnRenamed("v", "_b"), list(on))
    return joined.groupBy(*free).agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


def windowed_counts(events: DataFrame, time: str, state: str, width: str, late: str) -> DataFrame:
    """Counts of states in windows of event time; rows later than ``late`` are left out by the watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), state).agg(F.count("*").alias("n"))
