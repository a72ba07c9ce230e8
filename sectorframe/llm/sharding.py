"""Shards of near equal bytes by sampled splitters, in DataFrame operations only.

A row's key is a hash of its text, so that equal texts stand together. A sample of keys, drawn
by size, gives splitters: the quantiles that cut all rows into many more ranges than there are
shards. Ranges' exact bytes tell which shard each belongs to. A range that would overfill its
shard is subdivided by its rows' running sums, with rows of one key by id; so shards' ends lie
where they would if all rows were in one order, while only rows around them are put in order.

Rows larger than an even share (fewer than there are shards) have a shard each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

SHARDS = 40
#: Ranges for each shard, and sampled keys for each range, on average.
RANGES, SAMPLED = 8, 32
#: A group of equal texts of at most this part of a shard's share isn't cut.
SLACK = 64


def key() -> Column:
    """60 bits of a hash of the text; a null text has that of an empty one."""
    return F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def even_share(sizes: list[int], total: int, shards: int) -> tuple[int, int, int]:
    """How many of the largest rows (``sizes``, descending) have shards of their own, and what is left for how many.

    A row has if it is larger than an even share of what it and smaller ones hold.
    """
    own = 0
    for size in sizes:
        if shards - own <= 1 or size * (shards - own) <= total:
            break
        own, total = own + 1, total - size
    return own, total, shards - own


def _splitters(rows: DataFrame, total: int, shards: int) -> list[int]:
    """Quantiles of a sample of keys that is drawn by size: ``shards * RANGES * SAMPLED`` of them, on average."""
    want = shards * RANGES * SAMPLED
    at = F.pmod(F.xxhash64("key", "doc_id", "row"), F.lit(1 << 30)) / float(1 << 30)
    drawn = sorted(r.key for r in rows.where(at * total < F.col("size") * float(want)).select("key").collect())
    n = shards * RANGES
    return sorted({drawn[len(drawn) * k // n] for k in range(1, n)}) if drawn else []


def _range(splitters: list[int], low: int, high: int) -> Column:
    """The number of splitters that aren't over the key, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(F.col("key") < splitters[middle], _range(splitters, low, middle)).otherwise(_range(splitters, middle + 1, high))


def _shard(begin: Column, size: Column, total: int, shards: int) -> Column:
    """The shard in whose share the middle of some bytes lies."""
    return F.least(F.call_function("div", (2 * begin + size) * F.lit(shards), F.lit(2 * max(total, 1)).cast("bigint")), F.lit(shards - 1)).cast("int")


def _cut(rows: DataFrame, total: int, shards: int) -> DataFrame:
    """Rows of ranges that several shards share, each with its own shard."""
    keys = ["key", "doc_id", "row"]
    ordered = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "cut")
    own = ordered.withColumn("_part", F.shiftright("_at", 33))  # the upper bits tell the task that wrote the row
    pieces = own.groupBy("range", "_part").agg(F.sum("size").alias("_bytes"))
    before = F.coalesce(F.sum("_bytes").over(Window.partitionBy("range").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum("size").over(Window.partitionBy("range", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = own.withColumn("_within", within).join(pieces.select("range", "_part", before.alias("_before")), ["range", "_part"])
    begin = F.col("begin") + F.col("_before") + F.col("_within")
    out = stored(placed.select(*[c for c in rows.columns if c not in ("range", "begin")], begin.alias("begin"), _shard(begin, F.col("size"), total, shards).alias("shard")), "placed")
    groups = out.groupBy("key").agg(F.min("begin").alias("begin"), F.sum("size").alias("size"), F.min("shard").alias("first"), F.max("shard").alias("last"))
    whole = groups.where((F.col("first") < F.col("last")) & (F.col("size") * SLACK * shards <= total))
    # Fewer groups than shards: each has a shard's end within it.
    snapped = F.broadcast(whole.select("key", _shard(F.col("begin"), F.col("size"), total, shards).alias("_snapped")))
    return out.join(snapped, "key", "left").withColumn("shard", F.coalesce("_snapped", "shard")).drop("begin", "_snapped")


def shards_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row of ``docs`` (``doc_id, text``; others
    are ignored, whatever their names).

    ``size``: the text's bytes (null: none) and 16. A shard's bytes differ from an even share by at most half of the
    largest row at each end, or half of a group of equal texts that is no larger than a 64th of a share; rows larger
    than an even share have a shard each, the last ones by falling size. Larger groups of equal texts are cut by id
    (null first), and equal rows in the order of the input's files; slots go in the same order. With fewer rows than
    shards some are empty. An empty table has no rows.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    own = docs.select("doc_id", (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), key().alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = stored(own, "sized")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0]
    top = [r["size"] for r in rows.select("size").orderBy(F.desc("size")).limit(shards).collect()]
    heavy, left, rest = even_share(top, total, shards)
    light = rows.where(F.col("size") < top[heavy - 1]) if heavy else rows
    splitters = _splitters(light, left, rest)
    ranged = light.withColumn("range", _range(splitters, 0, len(splitters)))
    # One row for a range: 8 for each shard.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = stored(ranged.groupBy("range").agg(F.sum("size").alias("bytes")).select("range", "bytes", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("begin")), "ranges")
    ends = sums.select("range", "begin", _shard(F.col("begin"), F.lit(0), left, rest).alias("first"), _shard(F.col("begin") + F.col("bytes"), F.lit(0), left, rest).alias("last"))
    whole = ranged.join(F.broadcast(ends.where("first = last").select("range", F.col("first").alias("shard"))), "range").drop("range")
    cut = _cut(ranged.join(F.broadcast(ends.where("first < last").select("range", "begin")), "range"), left, rest)
    placed = whole.unionByName(cut)
    if heavy:
        place = F.row_number().over(Window.orderBy(F.desc("size"), "key", "doc_id", "row"))  # fewer rows than shards
        placed = placed.unionByName(rows.where(F.col("size") >= top[heavy - 1]).withColumn("shard", F.lit(shards) - place))
    out = numbered(placed, ["shard"], ["key", "doc_id", "row"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
