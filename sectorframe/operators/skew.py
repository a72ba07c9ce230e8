"""Contractions in which a few legs hold much of a table: hot legs are found first and joined by blocks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import contract
from .lineage import cut

#: Buckets of the sketch for each part that a table is dealt to. Hot buckets are at most one for each part, so that
#: about a sixteenth of a table's legs, besides the hot ones, are counted exactly.
WIDTH = 16


def _present(cells: DataFrame, on: Sequence[str]) -> DataFrame:
    return cells.where(reduce(and_, [F.col(c).isNotNull() for c in on]))


#: Cells of both sides in one part of a join, about.
CELLS = 1 << 18


def hot_legs(cells: DataFrame, on: Sequence[str], parts: int) -> DataFrame:
    """``on``, ``blocks``: the values of the legs that hold over ``1 / parts`` of all cells, at most ``parts`` of them, and
    the number of such shares that each fills.

    First a sketch: cells counted by a hash of their legs, in ``WIDTH * parts`` buckets. A hot leg's bucket can't hold
    less than the leg does, so none is missed; then only the legs in hot buckets are counted, exactly. Null legs, which
    meet nothing, don't count. The number of cells is read at once; an empty table has no hot legs.
    """
    return _hot(cells, on, parts)[0]


def _hot(cells: DataFrame, on: Sequence[str], parts: int) -> tuple[DataFrame, int]:
    """The hot legs and the number of cells."""
    own, at = _present(cells, on), F.pmod(F.xxhash64(*on), F.lit(WIDTH * parts))
    counts = own.groupBy(at.alias("_bucket")).agg(F.count("*").alias("_n")).collect()  # WIDTH * parts numbers, at most
    total = sum(r["_n"] for r in counts)
    share = total / parts
    hot = [r["_bucket"] for r in counts if r["_n"] > share]
    exact = own.where(at.isin(hot) if hot else F.lit(False)).groupBy(*on).agg(F.count("*").alias("_n"))
    return exact.where(F.col("_n") > share).select(*on, F.ceil(F.col("_n") / F.lit(share or 1.0)).cast("int").alias("blocks")), total


def _dealt(cells: DataFrame, hot: DataFrame, on: Sequence[str], own: str, other: str, axes: tuple[str, str]) -> DataFrame:
    """Cells with the block of their own side, chosen by a hash of the whole cell, once for each block of the other side."""
    free: list[Column] = [F.col(c) for c in cells.columns if c not in on]
    out = cells.join(F.broadcast(hot), list(on), "left")  # 2 * parts rows at most
    one = F.lit(1)
    place = F.pmod(F.xxhash64(*free), F.coalesce(own, one)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))
    return out.withColumn(axes[0], place).withColumn(axes[1], copies).drop("_left", "_right")


def split_contract(a: DataFrame, b: DataFrame, on: Sequence[str], free: Sequence[str] | None = None, parts: int | None = None) -> DataFrame:
    """:func:`contract`, the same rows, where single legs may hold any part of either table.

    A leg with over ``1 / parts`` of a side's cells (``parts`` is by default the number of shuffle partitions) is joined by
    blocks: a side of m blocks and one of n blocks meet in a grid of m times n keys, in each of which stand about two
    shares at most, and each two cells meet in one of them. A side's hot cells are so written as often as the other side has
    blocks, which is 1 unless the leg is hot there too. Blocks come of hashes, so that a lost task's rows come out the
    same. Legs that hold no such part are joined as they are. Both tables are read three times: store what is costly to
    make. Counts are read at once.
    """
    parts = parts or int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (left, one), (right, two) = _hot(a, on, parts), _hot(b, on, parts)
    hot = cut(left.withColumnRenamed("blocks", "_left").join(right.withColumnRenamed("blocks", "_right"), list(on), "full"))
    dealt = max(parts, -(-(one + two) // CELLS))
    if hot.isEmpty():
        return contract(a, b, on, free, parts=dealt)
    kept = [c for c in (*a.columns, *b.columns) if c not in (*on, "v", "sector")]
    one = _dealt(a.drop("sector"), hot, on, "_left", "_right", ("_p", "_q"))
    two = _dealt(b.drop("sector"), hot, on, "_right", "_left", ("_q", "_p"))
    return contract(one, two, [*on, "_p", "_q"], list(free) if free is not None else kept, parts=dealt)

