"""Contractions of several tables, summed after every join, in a given or a costed order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import normalise
from ..operators.joins import contract


def _legs(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c not in ("v", "sector")]


def cheapest_order(legs: Sequence[Sequence[str]], sizes: dict[str, int], keep: Sequence[str]) -> list[tuple[int, int]]:
    """Pairs to contract, by the smallest result (a product of leg sizes) at each step.

    A contracted pair is replaced by its result, at the end of the list.
    """
    left = [set(x) for x in legs]
    out = []
    while len(left) > 1:
        best = None
        for a in range(len(left)):
            for b in range(a + 1, len(left)):
                rest = set(keep).union(*(x for k, x in enumerate(left) if k not in (a, b)))
                cost = reduce(lambda p, leg: p * sizes[leg], (left[a] | left[b]) & rest, 1)
                apart = not left[a] & left[b]
                if best is None or (apart, cost) < best[0]:
                    best = ((apart, cost), a, b, (left[a] | left[b]) & rest)
        _, a, b, result = best
        out.append((a, b))
        left = [x for k, x in enumerate(left) if k not in (a, b)] + [result]
    return out


def contract_chain(tables: Sequence[DataFrame], keep: Sequence[str], order: Sequence[tuple[int, int]] | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """All legs but ``keep`` summed over; legs of one name are the same leg.

    Catalyst doesn't move sums below joins, so each step sums out the legs that no later table
    has before the next join. The order is as given, or costed from leg sizes, or left to right.
    Tables without a common leg can't be neighbours in the order.
    """
    left = list(tables)
    if order is None:
        order = cheapest_order([_legs(t) for t in tables], sizes, keep) if sizes else [(0, len(left) - 1 - k) if k else (0, 1) for k in range(len(left) - 1)]
    for a, b in order:
        one, two = left[a], left[b]
        on = [c for c in _legs(one) if c in _legs(two)]
        if not on:
            raise ValueError(f"no common leg of {_legs(one)} and {_legs(two)}")
        left = [t for k, t in enumerate(left) if k not in (a, b)]
        later = {*keep, *(c for t in left for c in _legs(t))}
        # A common leg that is still wanted is grouped by and not summed out.
        own = [c for c in dict.fromkeys(_legs(one) + _legs(two)) if c in later]
        left.append(contract(one, two, on, own) if len(own) else contract(one, two, on, []))
    return left[0].select(*keep, "v")


def project_basis(m: DataFrame, p: DataFrame, pt: DataFrame) -> tuple[DataFrame, float]:
    """``P^T M Pt`` over its norm, and the norm's logarithm, for cells ``(i, j)`` of m, ``(i, k)`` of p and ``(j, l)`` of pt."""
    reduced = contract_chain([m.select("i", "j", "v"), p.select("i", F.col("j").alias("k"), "v"), pt.select(F.col("i").alias("j"), F.col("j").alias("l"), "v")], ["k", "l"])
    return normalise(reduced.toDF("i", "j", "v"))
