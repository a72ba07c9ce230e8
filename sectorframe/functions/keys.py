"""Key rules and column expressions: sectors, legs, flat indices, complex values, histograms as text."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column], Column]

#: Rules make a sector of a sum of signed charges. ``int8`` wraps at 8 bits; ``const`` has one sector.
RULES: dict[str, Rule] = {
    "additive": lambda q: q,
    "int8": lambda q: F.pmod(q + 128, F.lit(256)) - 128,
    "const": lambda q: F.lit(0),
}


def rule(name: str | Rule) -> Rule:
    """A registered rule by name, ``mod m``, or a rule of the caller's own."""
    if callable(name):
        return name
    if name.startswith("mod "):
        m = int(name[4:])
        return lambda q: F.pmod(q, F.lit(m))
    return RULES[name]


def register_rule(name: str, own: Rule) -> None:
    RULES[name] = own


def combined(charges: Sequence[Column], signature: Sequence[bool], by: str | Rule = "additive") -> Column:
    """The sector of some charges: those of legs marked in the signature count negatively.

    Charges are added as INT, since adding TINYINT fails on overflow in ANSI mode.
    """
    signed = [(-c if flip else c).cast("int") for c, flip in zip(charges, signature, strict=True)]
    return rule(by)(reduce(lambda a, b: a + b, signed)).cast("int")


def with_sector(cells: DataFrame, catalog: DataFrame, legs: Mapping[str, int], signature: Sequence[bool], by: str | Rule = "additive", name: str = "sector") -> DataFrame:
    """Cells with the sector of some of their legs; ``legs`` maps a column to its leg in the catalog.

    One equi-join for a leg. Whether a catalog is broadcast is left to its size. Cells whose
    index isn't in the catalog are dropped (see ``check_blocks``).
    """
    out, charges = cells, []
    for k, (column, leg) in enumerate(legs.items()):
        own = catalog.where(F.col("leg") == leg).select(F.col("idx").alias(column), F.col("q").alias(f"_q{k}"))
        out = out.join(own, column)
        charges.append(F.col(f"_q{k}"))
    sector = combined(charges, signature, by)
    return out.withColumn(name, sector).select(*cells.columns, name)


def allowed_only(cells: DataFrame, row: str = "row_sector", col: str = "col_sector") -> DataFrame:
    """Cells whose row and column sectors agree."""
    return cells.where(F.col(row) == F.col(col))


def permute(cells: DataFrame, order: Sequence[str], legs: Sequence[str]) -> DataFrame:
    """Legs in another order: leg ``legs[k]`` of the result is ``order[k]`` of the input.

    Moves no data; sectors are derived columns, so they are derived anew if wanted.
    """
    if sorted(order) != sorted(legs):
        raise ValueError(f"{list(order)} is no permutation of {list(legs)}")
    if list(order) == list(legs):
        return cells
    rest = [c for c in cells.columns if c not in legs]
    return cells.select(*[F.col(o).alias(name) for o, name in zip(order, legs, strict=True)], *rest)


def transpose(cells: DataFrame, row: str = "i", col: str = "j", sector: str | None = "sector") -> DataFrame:
    """Rows and columns exchanged; a sector becomes its opposite."""
    keep = {row: F.col(col), col: F.col(row)}
    if sector in cells.columns:
        keep[sector] = -F.col(sector)
    return cells.withColumns(keep)


def conjugate(cells: DataFrame, v: str = "v") -> DataFrame:
    """Complex conjugate; real values stay."""
    if not cells.schema[v].dataType.typeName() == "struct":
        return cells
    return cells.withColumn(v, F.struct(F.col(v)["re"].alias("re"), (0 - F.col(v)["im"]).alias("im")))


def dagger(cells: DataFrame, row: str = "i", col: str = "j", v: str = "v") -> DataFrame:
    """The adjoint: exchanged, conjugated, with its sector kept."""
    return conjugate(transpose(cells, row, col, sector=None), v)


def flip_legs(catalog: DataFrame, legs: Sequence[int]) -> DataFrame:
    """The catalog with the charges of some legs negated, for legs whose orientation is flipped."""
    return catalog.withColumn("q", F.when(F.col("leg").isin(list(legs)), -F.col("q")).otherwise(F.col("q")))


def dual(catalog: DataFrame) -> DataFrame:
    """The catalog with all orientations flipped; values stay."""
    return catalog.withColumn("q", -F.col("q"))


def resector(cells: DataFrame, by: str | Rule, name: str = "sector") -> DataFrame:
    """Cells under a coarser rule; values stay."""
    return cells.withColumn(name, rule(by)(F.col(name)).cast("int"))


def scale(cells: DataFrame, x: float, v: str = "v") -> DataFrame:
    return cells.withColumn(v, F.col(v) * F.lit(float(x)))


def negate(cells: DataFrame, v: str = "v") -> DataFrame:
    """Opposite values; the opposite of 0 is 0, not -0."""
    return cells.withColumn(v, F.lit(0.0) - F.col(v))


def divide(cells: DataFrame, x: float, v: str = "v") -> DataFrame:
    if x == 0:
        raise ZeroDivisionError("cells divided by 0")
    return cells.withColumn(v, F.col(v) / F.lit(float(x)))


def ravel(legs: Sequence[Column], shape: Sequence[int]) -> Column:
    """The flat index, the last leg fastest. It tells the legs (see :func:`unravel`) if all but the first are under their size
    in the shape: see :func:`shape_of`."""
    return reduce(lambda at, part: at * F.lit(int(part[1])) + part[0], zip(legs[1:], shape[1:], strict=True), legs[0]).cast("bigint")


def shape_of(cells: DataFrame, legs: Sequence[str]) -> list[int]:
    """The least shape that holds all cells: one more than each leg's largest index. Runs at once."""
    row = cells.agg(*[F.max(c) for c in legs]).head()
    return [1 + (x if x is not None else -1) for x in row]


def unravel(flat: Column, shape: Sequence[int]) -> list[Column]:
    """The legs' indices of a flat index; all but the first must have been under their size in the shape."""
    out, rest = [], flat.cast("bigint")
    for size in reversed(shape[1:]):
        place = F.pmod(rest, F.lit(int(size)).cast("bigint"))
        out.append(place)
        rest = F.call_function("div", rest - place, F.lit(int(size)).cast("bigint"))  # whole: doubles end at 2^53
    return [rest, *reversed(out)]


#: Operations on single weights.
WEIGHT_OPS: dict[str, Callable[[Column, float], Column]] = {
    "scale": lambda v, x: v * x,
    "divide": lambda v, x: v / x,
    "reciprocal": lambda v, x: F.lit(float(x)) / v,
    "power": lambda v, x: F.pow(v, F.lit(float(x))),
    "negate": lambda v, x: F.lit(0.0) - v,
}


def weights_map(weights: DataFrame, op: str, x: float = 1.0) -> DataFrame:
    """Each weight scaled, divided, inverted, raised or negated."""
    return weights.withColumn("v", WEIGHT_OPS[op](F.col("v"), x))


def parse_hist(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """``(key, n)`` rows of text such as ``2*1 + 3*5`` (n times key); an empty text has none."""
    words = F.explode(F.filter(F.split(F.col(column), r"\s*\+\s*"), lambda w: w != ""))
    parts = df.select(*keep, words.alias("_w")).withColumn("_p", F.split("_w", r"\*"))
    return parts.select(*keep, F.trim(F.col("_p")[1]).cast("int").alias("key"), F.trim(F.col("_p")[0]).cast("bigint").alias("n"))


def format_hist(hist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A histogram (one for each group) as text, keys ascending: a histogram's keys are the bound of a group."""
    ordered = F.sort_array(F.collect_list(F.struct("key", "n")))
    text = F.array_join(F.transform(ordered, lambda x: F.concat_ws("*", x["n"].cast("string"), x["key"].cast("string"))), " + ")
    return hist.groupBy(*by).agg(text.alias("hist"))
