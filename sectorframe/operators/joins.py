"""Products, sums and scalings of cells: equi-joins on legs, then partial sums.

Joins hash on legs, not on sectors, as sectors are few and uneven. Which side is broadcast is
left to sizes known at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import sector_except, sector_intersect


def contract(a: DataFrame, b: DataFrame, on: Sequence[str], free: Sequence[str] | None = None, sector: str | None = None, parts: int | None = None) -> DataFrame:
    """Sum over the shared legs ``on`` of products of cells, for each combination of the free legs.

    ``parts`` deals both sides to so many parts, for products that are many times the cells: a task then sums a part's,
    whatever is merged at run time by the size of what is shuffled.

    ``sector``: a column of both that the shared legs determine; as a further join key it
    prunes and changes nothing. Legs of one name on both sides must be in ``on``.
    """
    keys = [*on, *([sector] if sector else [])]
    left = [c for c in a.columns if c not in (*keys, "v", "sector")]
    right = [c for c in b.columns if c not in (*keys, "v", "sector")]
    free = list(free) if free is not None else left + right
    one, two = a.select(*keys, *left, F.col("v").alias("_a")), b.select(*keys, *right, F.col("v").alias("_b"))
    if parts:
        one, two = one.repartition(parts, *keys), two.repartition(parts, *keys)
    return one.join(two, keys).groupBy(*free).agg(F.sum(F.col("_a") * F.col("_b")).alias("v"))


#: Columns that one row of :func:`block_times` holds.
WIDTH = 8


def block_times(cells: DataFrame, x: DataFrame) -> DataFrame:
    """``sector, i, k, v``: cells ``(sector, i, j, v)`` times the columns k (from 0) of ``x``, ``(sector, i, k, v)``; zeros are left out.

    WIDTH columns go in one row, so that a cell is met, summed and shuffled once for them all.
    """
    each = range(WIDTH)
    at, place = F.floor(F.col("k") / WIDTH), F.pmod("k", F.lit(WIDTH))
    packed = x.groupBy("sector", F.col("i").alias("j"), at.alias("_b")).agg(*[F.sum(F.when(place == c, F.col("v"))).alias(f"_x{c}") for c in each])
    sums = cells.select("sector", "i", "j", "v").join(packed, ["sector", "j"]).groupBy("sector", "i", "_b").agg(*[F.sum(F.col("v") * F.col(f"_x{c}")).alias(f"_x{c}") for c in each])
    out = sums.select("sector", "i", "_b", F.posexplode(F.array(*[f"_x{c}" for c in each])).alias("_c", "v"))
    return out.where("v <> 0").select("sector", "i", (F.col("_b") * WIDTH + F.col("_c")).alias("k"), "v")


def add(a: DataFrame, b: DataFrame, legs: Sequence[str] = ("i", "j"), sign: int = 1) -> DataFrame:
    """Sum of cells, an absent one being 0, whatever sectors either side has: a union and one shuffle."""
    keep = [*legs, *(["sector"] if "sector" in a.columns and "sector" in b.columns else [])]
    other = b.select(*keep, (F.col("v") if sign > 0 else F.lit(0.0) - F.col("v")).alias("v"))
    return a.select(*keep, "v").unionByName(other).groupBy(*keep).agg(F.sum("v").alias("v"))


def sub(a: DataFrame, b: DataFrame, legs: Sequence[str] = ("i", "j")) -> DataFrame:
    return add(a, b, legs, -1)


def scale_legs(cells: DataFrame, weights: DataFrame, legs: Sequence[str], sector: Column | str = "sector", op: str = "*") -> DataFrame:
    """Each cell times (or over) the weights at the positions of the legs given.

    ``sector`` gives the weights' key, negated by the caller where orientations differ. Sectors
    without weights are dropped (``missing_sectors`` tells them).
    """
    out = cells.withColumn("_s", F.col(sector) if isinstance(sector, str) else sector)
    for leg in legs:
        own = weights.select(F.col("sector").alias("_s"), F.col("pos").alias(leg), F.col("v").alias("_w"))
        out = out.join(own, ["_s", leg]).withColumn("v", F.col("v") * F.col("_w") if op == "*" else F.col("v") / F.col("_w")).drop("_w")
    return out.select(*cells.columns)


def full_contract(a: DataFrame, b: DataFrame, dim: str | None = None) -> DataFrame:
    """One number: the sum of ``a[i, j] * b[j, i]``, times the sector's dimension if ``a`` has such a column."""
    other = b.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("v").alias("_b"))
    factor = F.col(dim) if dim else F.lit(1.0)
    return a.join(other, ["i", "j"]).agg(F.coalesce(F.sum(factor * F.col("v") * F.col("_b")), F.lit(0.0)).alias("v"))


def shared_sectors(*tables: DataFrame) -> list[DataFrame]:
    """The tables restricted to the sectors that all have."""
    common = sector_intersect(*tables)
    return [t.join(common, "sector", "left_semi") for t in tables]


def grid_neighbours(grid: DataFrame, dx: int, dy: int, size: tuple[int, int]) -> DataFrame:
    """``x, y, label, nx, ny, neighbour`` on a periodic grid of ``(x, y, label)``."""
    nx, ny = F.pmod(F.col("x") + dx, F.lit(size[0])), F.pmod(F.col("y") + dy, F.lit(size[1]))
    other = grid.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("label").alias("neighbour"))
    return grid.withColumns({"nx": nx.cast("int"), "ny": ny.cast("int")}).join(other, ["nx", "ny"]).select("x", "y", "label", "nx", "ny", "neighbour")


def weights_combine(a: DataFrame, b: DataFrame, op: str | dict[str, str]) -> DataFrame:
    """Product, sum or difference (``*``, ``+``, ``-``) of two tables of weights; raises unless their keys match.

    ``op`` may name several results, ``{column: op}``, which then stand in place of ``v``. Keys are checked at once, on the
    join that gives the results, which is checkpointed.
    """
    keys = ["sector", "pos"]
    own, other = a.withColumn("_in", F.lit(True)), b.select(*keys, F.col("v").alias("_b"), F.lit(True).alias("_other"))
    joined = own.join(other, keys, "full").checkpoint()
    if not joined.where("_in IS NULL OR _other IS NULL").isEmpty():
        raise ValueError("weights of different keys")
    of = {"*": F.col("v") * F.col("_b"), "+": F.col("v") + F.col("_b"), "-": F.col("v") - F.col("_b")}
    if isinstance(op, str):
        return joined.withColumn("v", of[op]).select(*a.columns)
    return joined.select(*[c for c in a.columns if c != "v"], *[of[o].alias(name) for name, o in op.items()])


def missing_sectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sectors of ``a`` that an operation with ``b`` would drop."""
    return sector_except(a, b)
