"""Cells from arrays, facts, weights and random numbers; saved and loaded by name."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cells_from_arrays(df: DataFrame, row: str, array: str, zeros: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """``i, j, v`` and the columns ``keep``: one cell for each element of an array column; zeros are left out unless asked for.

    A null element raises when it is met: absent cells mean 0, nulls mean nothing.
    """
    cells = df.select(F.col(row).cast("bigint").alias("i"), *keep, F.posexplode(array).alias("j", "v"))
    cells = cells.select("i", F.col("j").cast("bigint").alias("j"), F.col("v").cast("double").alias("v"), *keep)
    cells = cells.withColumn("v", F.coalesce("v", F.raise_error(F.lit("null element")).cast("double")))
    return cells if zeros else cells.where("v <> 0")


#: Facts of one part, about, where they are dealt by key.
FACTS = 1 << 19


def parts_of(df: DataFrame) -> int:
    """How many parts of FACTS rows a table has. Counts at once."""
    return max(1, -(-df.count() // FACTS))


def cells_from_facts(df: DataFrame, legs: Mapping[str, Column | str], measure: Column | str, agg: str = "sum", parts: int | None = None) -> DataFrame:
    """One leg for each dimension key; rows with equal keys are aggregated (partially before the shuffle).

    ``parts`` is for keys that hardly repeat, where that saves nothing: rows are dealt to so many parts by their keys, so that
    what a task holds is bounded by a part's rows (see :func:`parts_of`), however small the rows become when shuffled.
    """
    names = {k: F.col(c) if isinstance(c, str) else c for k, c in legs.items()}
    value = F.col(measure) if isinstance(measure, str) else measure
    how = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}[agg]
    if parts:
        rows = df.select(*[c.cast("bigint").alias(k) for k, c in names.items()], value.alias("v")).repartition(parts, *names)
        return rows.groupBy(*names).agg(how("v").cast("double").alias("v"))
    return df.groupBy(*[c.cast("bigint").alias(k) for k, c in names.items()]).agg(how(value).cast("double").alias("v"))


#: Rows and columns of a block of random cells, about.
BLOCK = 1 << 8, 1 << 12


def random_cells(rows: DataFrame, cols: DataFrame, seed: int = 0) -> DataFrame:
    """``i, j, sector, v``: a value from [-0.5, 0.5) at each allowed pair of ``(idx, sector)`` rows.

    Values are hashes of the indices, so they don't depend on how rows are dealt to tasks. Indices go in blocks: a sector's
    blocks of rows meet its blocks of columns, and pairs are made where two blocks have met, so that what is shuffled and
    joined is thousands of times less than the cells, which are rows times columns by definition. Counts at once.
    """

    def blocks(x: DataFrame, size: int, name: str) -> tuple[DataFrame, DataFrame]:
        counts = x.groupBy("sector").agg(F.ceil(F.count("*") / size).cast("bigint").alias("_n"))
        placed = x.join(counts, "sector").groupBy("sector", F.pmod(F.xxhash64("idx"), "_n").alias(name))
        return placed.agg(F.collect_list("idx").alias(f"{name}s")), counts

    left, _ = blocks(rows, BLOCK[0], "_i")
    right, counts = blocks(cols, BLOCK[1], "_j")
    parts = counts.agg(F.sum("_n")).head()[0] or 1
    each = left.join(counts, "sector").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    met = each.repartition(parts, "sector", "_j").join(right.repartition(parts, "sector", "_j"), ["sector", "_j"])
    pairs = met.select("sector", "_is", F.explode("_js").alias("j")).select("sector", "j", F.explode("_is").alias("i"))
    v = F.pmod(F.xxhash64("i", "j", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53)) - 0.5
    return pairs.select("i", "j", "sector", v.alias("v"))


def save_cells(df: DataFrame, path: str, name: str, tag: str, legs: Sequence[str], signature: Sequence[bool]) -> None:
    """Write cells (or weights) under a name, by sector, with their tag, legs and signature. Runs at once."""
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy("sector").parquet(f"{path}/tensors/{name}")
    entry = [(name, tag, list(legs), [bool(s) for s in signature], json.dumps(df.columns))]
    spark.createDataFrame(entry, "name string, tag string, legs array<string>, signature array<boolean>, columns string").coalesce(1).write.mode("overwrite").parquet(f"{path}/catalog/{name}")


def load_cells(spark: SparkSession, path: str, name: str, tag: str | None = None) -> DataFrame:
    """Cells saved under a name; raises if their tag isn't the one expected."""
    entry = spark.read.parquet(f"{path}/catalog/{name}").head()
    if tag is not None and entry.tag != tag:
        raise ValueError(f"{name} has the tag {entry.tag}, not {tag}")
    return spark.read.parquet(f"{path}/tensors/{name}").select(*json.loads(entry.columns))


def saved(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """The catalog's entries of some names."""
    return spark.read.parquet(*[f"{path}/catalog/{n}" for n in names])


def densify(cells: DataFrame, rows: DataFrame, cols: DataFrame, as_matrix: bool = False) -> DataFrame:
    """Every pair of the indices ``idx`` of two catalogs, zeros filled; ``as_matrix`` packs rows into arrays.

    Its size is rows times columns by definition.
    """
    pairs = rows.select(F.col("idx").alias("i")).crossJoin(cols.select(F.col("idx").alias("j")))
    full = pairs.join(cells.select("i", "j", "v"), ["i", "j"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    if not as_matrix:
        return full
    packed = F.transform(F.sort_array(F.collect_list(F.struct("j", "v"))), lambda x: x["v"])
    return full.groupBy("i").agg(packed.alias("row"))


def cells_from_weights(weights: DataFrame) -> DataFrame:
    """The square diagonal cells of weights."""
    return weights.select("sector", F.col("pos").alias("i"), F.col("pos").alias("j"), "v")
