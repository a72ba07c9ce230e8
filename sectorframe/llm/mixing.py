"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source gets a target, a share of all words by weight. Each of its documents is due the
same real number of copies, target over size; its whole part is given and the fraction is
rounded. Two fractions at a time meet: words move from one document to the other, in a random
direction such that no expectation changes, until one fraction is 0 or 1; the other goes on.
The sum of words stays until a source has one fraction left; that goes to the nearer whole
number, so a source misses its target by at most half of one document.

Fractions meet in blocks of bounded size, then the one that each block leaves meets those of
other blocks, up a tree whose depth is the logarithm of a source's documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, numbered, stored

#: Documents of a block, on average; they are dealt by a hash.
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one id, source and size that one array numbers, at most.
RUN = 1 << 12
#: An item with more than this share of all rows is ranked by ranges; fewer items than this can be so large.
HOT = 1000


def targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """``source, n, source_size, target`` from ``source, n, source_size``.

    Weights repeat over the sources by code point, null last. They share the sum of all sizes;
    a target stops at ``most`` times its source's size and the excess goes to the others by
    weight. One row for a source, ordered in one task: the table of sources is the bound.
    """
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "place")
    everything = Window.partitionBy()
    placed = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    due = placed.withColumns({"weight": weight, "cap": F.col("source_size") * float(most)}).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # Sources up to the last whose cap is under its share at that level stop at the cap.
    found = due.withColumn("level", level).withColumn("stops", F.col("ratio") < F.col("level"))
    free = F.max(F.when(~F.col("stops"), F.col("level"))).over(everything)
    share = F.when(F.col("stops"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * free))
    return found.withColumn("target", F.coalesce(share, F.lit(0.0))).select("source", "n", "source_size", "target")


def _meet(state: Column, new: Column) -> Column:
    """One step: the fraction that goes on, and those that are settled."""
    old = state["rest"]
    up = F.least((1 - new["p"]) * new["size"], old["p"] * old["size"])
    down = F.least(new["p"] * new["size"], (1 - old["p"]) * old["size"])
    rises = new["u"] * (up + down) < down
    new_ends = F.when(rises, (1 - new["p"]) * new["size"] <= old["p"] * old["size"]).otherwise(new["p"] * new["size"] <= (1 - old["p"]) * old["size"])

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["size"].alias("size"), p.cast("double").alias("p"), x["u"].alias("u"), x["item"].alias("item"))

    rest = F.when(new_ends, with_p(old, F.when(rises, old["p"] - up / old["size"]).otherwise(old["p"] + down / old["size"]))).otherwise(
        with_p(new, F.when(rises, new["p"] + up / new["size"]).otherwise(new["p"] - down / new["size"]))
    )
    settled = F.when(new_ends, with_p(new, F.when(rises, 1.0).otherwise(0.0))).otherwise(with_p(old, F.when(rises, 0.0).otherwise(1.0)))
    return F.struct(rest.alias("rest"), F.concat(state["settled"], F.array(settled)).alias("settled"))


def _round(items: DataFrame) -> DataFrame:
    """One level of the tree: ``place, source_key, one, settled`` from ``source_key, place, one``."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("one.size")).alias("by"), F.col("one.u").alias("u"), "one")))
    blocks = items.groupBy("source_key", "place").agg(F.transform(ordered, lambda x: x["one"]).alias("block"))
    empty = F.expr("filter(block, x -> false)")
    met = F.aggregate(F.expr("slice(block, 2, greatest(size(block) - 1, 0))"), F.struct(F.col("block")[0].alias("rest"), empty.alias("settled")), _meet)
    out = blocks.select("source_key", "place", met.alias("met"))
    return out.select("source_key", "place", "met.rest", "met.settled")


def _words(size: Column | None) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint") if size is None else size


def copies(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 7, block: int = BLOCK, size: Column | None = None) -> DataFrame:
    """``doc_id, source, size, source_size, target, m, total`` for each distinct ``doc_id, source, size``:
    its ``m`` rows get ``total`` copies together.

    Null ids and sources are values of their own; rows that share ``doc_id``, ``source`` and
    ``size`` count as one item of many copies. Texts without words are due copies like others
    and settle at once, as they hold no words. Equal input gives equal output.
    """
    items = stored(docs.select("doc_id", "source", _words(size).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "sizes")
    sources = items.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.col("size") * F.col("m")).alias("source_size"))
    aims = stored(targets(sources, weights, most), "targets").withColumn("source_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))
    joined = items.withColumn("source_key", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull())).join(aims.drop("source"), "source_key")
    due = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    key = F.xxhash64(F.lit(seed), "doc_id", "source", "size")
    level = joined.withColumns({"due": due, "key": key}).withColumns({"whole": F.floor("due"), "p": F.col("due") - F.floor("due")})
    keep = F.struct("doc_id", "source", "size", "source_size", "target", "m", "whole", "key", "n")
    one = F.struct(F.col("size").cast("double").alias("size"), "p", (F.pmod(F.xxhash64("key", F.lit("u")), F.lit(1 << 30)) / float(1 << 30)).alias("u"), keep.alias("item"))
    fraction = (F.col("p") > 0) & (F.col("size") > 0)
    settled = [level.where(~fraction).select(keep.alias("item"), F.lit(0.0).alias("p"))]
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("bigint")
    waiting = level.where(fraction).select("source_key", F.pmod("key", blocks).alias("place"), blocks.alias("blocks"), one.alias("one"))
    most_blocks = -(-(items.groupBy("source").count().agg(F.max("count")).head()[0] or 0) // block)
    while True:
        met = stored(_round(waiting.select("source_key", "place", "one")), "met")
        settled.append(met.select(F.explode("settled").alias("one")).select("one.item", "one.p"))
        if most_blocks <= 1:
            last = F.when(F.col("rest.p") < 0.5, 0.0).otherwise(1.0)
            settled.append(met.select("rest.item", last.alias("p")))
            break
        most_blocks = -(-most_blocks // block)
        waiting = met.select("source_key", F.pmod(F.xxhash64("place"), F.lit(most_blocks)).alias("place"), F.struct(F.col("rest.size").alias("size"), F.col("rest.p").alias("p"), (F.pmod(F.xxhash64("rest.item.key", F.lit(most_blocks)), F.lit(1 << 30)) / float(1 << 30)).alias("u"), F.col("rest.item").alias("item")).alias("one"))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out.select("item.doc_id", "item.source", "item.size", "item.source_size", "item.target", "item.m", (F.col("item.whole") + F.col("p")).cast("bigint").alias("total"))


def _own(total: Column, m: Column, k: Column) -> Column:
    """Copies of row k (from 1) of an item's m rows."""
    return F.floor(total / m) + F.when(k <= total % m, 1).otherwise(0)


def _numbered(items: DataFrame) -> DataFrame:
    """Each item as often as its ``m`` says, numbered by ``k`` from 1. Items of very many rows, such as those without
    id and text, are dealt to all tasks in runs of a bounded length."""
    one = F.lit(1).cast("bigint")
    few = items.where(F.col("m") <= RUN).withColumn("k", F.explode(F.sequence(one, F.col("m"))))
    run = F.explode(F.sequence(one, F.col("m"), F.lit(RUN).cast("bigint")))
    runs = items.where(F.col("m") > RUN).withColumn("run", run).repartition("doc_id", "source", "size", "run")
    many = runs.withColumn("k", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN - 1, F.col("m"))))).drop("run")
    return few.unionByName(many)


def mixed_sizes(docs: DataFrame, **how) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies`` of every row; see :func:`copies`."""
    rows = _numbered(stored(copies(docs, **how), "copies"))
    own = _own(F.col("total"), F.col("m"), F.col("k"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * own).cast("bigint").alias("taken"), own.cast("bigint").alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows: each row of ``docs`` (``doc_id, source, text`` and any others, whatever their names) as often
    as it has copies. Rows of one id, source and size share their copies as evenly as they go, by a hash of the text, so
    that the input's layout changes nothing but which of equal rows is copied."""
    return guarded(docs, lambda d: _mixed(d, **how))


def _mixed(docs: DataFrame, **how) -> DataFrame:
    words = _words(how.get("size"))
    keys = {"_d": F.coalesce("doc_id", F.lit(0)), "_dn": F.col("doc_id").isNull(), "_s": F.coalesce("source", F.lit("")), "_sn": F.col("source").isNull()}
    rows = docs.withColumns(keys | {"_w": words})
    names = [*keys, "_w"]
    found = stored(copies(docs, **how).withColumns(keys).select(*keys, F.col("size").alias("_w"), F.col("m").alias("_m"), F.col("total").alias("_total")), "copies")
    n, largest = found.agg(F.coalesce(F.sum("_m"), F.lit(0)), F.coalesce(F.max("_m"), F.lit(0))).head()
    many = max(RUN, n // HOT)
    hot = F.broadcast(found.where(F.col("_m") > many))  # fewer than HOT rows, as each stands for more than n / HOT
    usual = rows.join(hot.select(*names), names, "left_anti") if largest > many else rows
    ranked = usual.withColumn("_k", F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64("text"))))
    placed = ranked.join(found, names)
    if largest > many:  # in the same order, dealt by ranges
        own = rows.join(hot, names).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
        ranked = numbered(own, names, ["_hash", "_row"]).withColumn("_k", F.col("rank") + 1)
        placed = placed.unionByName(ranked.drop("_hash", "_row", "begin", "rank", "total"))
    copied = placed.withColumn("_n", _own(F.col("_total"), F.col("_m"), F.col("_k")).cast("int")).where("_n > 0")
    return copied.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)
