"""Sets of sectors. Each is small next to its cells: distinct runs partially before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def sectors(df: DataFrame) -> DataFrame:
    return df.select("sector").distinct()


def sector_union(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), [sectors(t) for t in tables]).distinct()


def sector_intersect(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [sectors(t) for t in tables])


def sector_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sectors of ``a`` that ``b`` lacks: what an inner operation with ``b`` drops."""
    return sectors(a).join(sectors(b), "sector", "left_anti")
