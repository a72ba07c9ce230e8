"""Checks of layouts, references and sector rules. Each returns rows of violations, or a number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import grid_neighbours

#: Share of the norm that forbidden cells may hold.
NORM_TOLERANCE = 4e-13


def off_sector_mass(cells: DataFrame, row: str = "row_sector", col: str = "col_sector") -> DataFrame:
    """``total, lost, share, ok``: squared norm, that of forbidden cells, and the relative loss of norm."""
    square = F.col("v") * F.col("v")
    sums = cells.agg(F.coalesce(F.sum(square), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(F.col(row) != F.col(col), square)), F.lit(0.0)).alias("lost"))
    share = F.when(F.col("total") > 0, 1 - F.sqrt((F.col("total") - F.col("lost")) / F.col("total"))).otherwise(0.0)
    return sums.withColumn("share", share).withColumn("ok", F.col("share") <= NORM_TOLERANCE)


def require_on_sector(cells: DataFrame, row: str = "row_sector", col: str = "col_sector") -> DataFrame:
    """The allowed cells; raises if dropping the others loses more of the norm than the tolerance. Sums at once."""
    if not off_sector_mass(cells, row, col).head().ok:
        raise ValueError("cells outside the allowed sectors")
    return cells.where(F.col(row) == F.col(col))


def check_bond_table(bonds: DataFrame) -> DataFrame:
    """``bond, n, problem`` of bonds that aren't on exactly two tensors, of ids that are missing from
    ``0..n-1``, and of bonds that a tensor has twice. Finds the largest id at once."""
    per_tensor = bonds.groupBy("bond", "tensor").agg(F.count("*").alias("times"))
    per_bond = per_tensor.groupBy("bond").agg(F.sum("times").alias("n"), F.max("times").alias("most"))
    negative = per_bond.where("bond < 0").select("bond", "n", F.lit("negative").alias("problem"))
    count = per_bond.where("bond >= 0 AND n <> 2").select("bond", "n", F.lit("count").alias("problem"))
    twice = per_bond.where("most > 1").select("bond", "n", F.lit("twice").alias("problem"))
    last = bonds.agg(F.max("bond")).head()[0]
    every = bonds.sparkSession.range(0, (-1 if last is None else last) + 1).withColumnRenamed("id", "bond")
    missing = every.join(per_bond, "bond", "left_anti").select(F.col("bond"), F.lit(0).cast("bigint").alias("n"), F.lit("missing").alias("problem"))
    return negative.unionByName(count).unionByName(twice).unionByName(missing)


def _difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    left = a.select(*keys).join(b.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("left"))
    right = b.select(*keys).join(a.select(*keys), list(keys), "left_anti").withColumn("side", F.lit("right"))
    return left.unionByName(right)


def check_square(catalog: DataFrame, rows: Sequence[int], cols: Sequence[int], signature: Sequence[bool]) -> DataFrame:
    """``leg, idx, q, side`` of indices that a row leg or its column leg lacks; raises if orientations agree."""
    half = len(rows)
    if any(signature[k] == signature[half + k] for k in range(half)):
        raise ValueError("row and column legs of one orientation")
    out = None
    for r, c in zip(rows, cols, strict=True):
        own = [catalog.where(F.col("leg") == leg).select(F.lit(r).alias("leg"), "idx", "q") for leg in (r, c)]
        found = _difference(*own, ["leg", "idx", "q"])
        out = found if out is None else out.unionByName(found)
    return out


def layout_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """``leg, idx, q, side`` of catalog rows that only one side has."""
    return _difference(a, b, ["leg", "idx", "q"])


def match_layout(a: DataFrame, b: DataFrame, signature_a: Sequence[bool], signature_b: Sequence[bool]) -> bool:
    """Whether legs, charges and signatures agree; never raises for layouts. Runs at once."""
    return list(signature_a) == list(signature_b) and layout_differences(a, b).isEmpty()


def check_blocks(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """``i, j, problem`` of cells whose index no catalog ``(idx, sector)`` has, or whose sides have other sectors than they say."""
    known = cells.select("i", "j", "sector").join(rows.select(F.col("idx").alias("i"), F.col("sector").alias("_r")), "i", "left").join(cols.select(F.col("idx").alias("j"), F.col("sector").alias("_c")), "j", "left")
    problem = F.when(F.col("_r").isNull() | F.col("_c").isNull(), "index").when((F.col("_r") != F.col("sector")) | (F.col("_c") != F.col("sector")), "sector")
    return known.withColumn("problem", problem).where(F.col("problem").isNotNull()).select("i", "j", "problem")


def empty_blocks(sizes: DataFrame, cells: DataFrame) -> DataFrame:
    """Sectors of ``block_sizes`` that hold no cell."""
    return sizes.join(cells.select("sector").distinct(), "sector", "left_anti")


def check_grid(grid: DataFrame, charges: DataFrame, dx: int, dy: int, size: tuple[int, int]) -> DataFrame:
    """Neighbours whose facing legs differ: ``x, y, label, neighbour, q, other_q``.

    charges: ``label, q, out`` of each site's leg; neighbours must have equal charges and
    opposite orientations, and have both to be compared.
    """
    near = grid_neighbours(grid, dx, dy, size)
    own = charges.select("label", "q", F.col("out").alias("_o"))
    other = charges.select(F.col("label").alias("neighbour"), F.col("q").alias("other_q"), F.col("out").alias("_p"))
    joined = near.join(own, "label").join(other, "neighbour")
    return joined.where((F.col("q") != F.col("other_q")) | (F.col("_o") == F.col("_p"))).select("x", "y", "label", "neighbour", "q", "other_q")


def check_references(edges: DataFrame, tensors: DataFrame, gates: DataFrame) -> DataFrame:
    """``id, problem`` of broken references among ``edges(bond, a, b)``, ``tensors(tensor)`` and ``gates(bond)``."""
    ends = edges.select("bond", F.col("a").alias("tensor")).union(edges.select("bond", F.col("b").alias("tensor")))
    unknown = ends.join(tensors, "tensor", "left_anti").select(F.col("tensor").alias("id"), F.lit("unknown tensor").alias("problem"))
    same = edges.where("a = b").select(F.col("bond").alias("id"), F.lit("equal ends").alias("problem"))
    unused = tensors.join(ends, "tensor", "left_anti").select(F.col("tensor").alias("id"), F.lit("unused tensor").alias("problem"))
    no_gate = edges.join(gates, "bond", "left_anti").select(F.col("bond").alias("id"), F.lit("bond without gate").alias("problem"))
    no_bond = gates.join(edges, "bond", "left_anti").select(F.col("bond").alias("id"), F.lit("gate without bond").alias("problem"))
    return unknown.union(same).union(unused).union(no_gate).union(no_bond).distinct()
