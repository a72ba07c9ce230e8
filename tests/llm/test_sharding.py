"""Shards against one order of all rows, with running sums in plain Python."""

import random
import zlib
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from sectorframe.llm.sharding import SLACK, shards_by_bytes

SCHEMA = "doc_id bigint, text string"


def _expected(rows, shards):
    own = []
    for doc_id, text in rows:
        raw = (text or "").encode()
        own.append((int(md5(raw).hexdigest()[:15], 16), doc_id is not None, doc_id or 0, len(raw) + 16, zlib.crc32(raw)))
    by_size = sorted(own, key=lambda r: (-r[3], r[:3]))
    left, k, out = sum(r[3] for r in own), shards, []
    while by_size and k > 1 and by_size[0][3] * k > left:
        r = by_size.pop(0)
        out.append((r, k - 1))
        left, k = left - r[3], k - 1
    begin, keys = 0, {}
    for r in sorted(by_size):
        keys.setdefault(r[0], [begin, 0])[1] += r[3]
        begin += r[3]
    begin = 0
    for r in sorted(by_size):
        first, size = keys[r[0]] if keys[r[0]][1] * SLACK * k <= left else (begin, r[3])
        out.append((r, min(k - 1, (2 * first + size) * k // (2 * left))))
        begin += r[3]
    slots = {}
    for r, shard in sorted(out):
        slot = slots[shard] = slots.get(shard, -1) + 1
        yield (r[2] if r[1] else None), r[3], r[4], "bytes", shard, slot, None


def _rows(n, draw):
    for k in range(n):
        text = draw.choice(["hot", None, "", "é" * draw.randrange(40), *["w " * draw.randrange(1, 400) for _ in range(9)]])
        yield draw.choice([None, *[k] * 20]), text


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize(("n", "shards"), [(0, 40), (1, 40), (30, 40), (3000, 40), (3000, 7), (50, 1)])
def test_shards_are_those_of_one_order(spark, n, shards):
    """Null ids and texts, empty texts, repeated rows and ids, a hot text, columns of clashing names."""
    rows = list(_rows(n, random.Random(n + shards)))
    rows += rows[: n // 3]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "size", "shard", "range", "row")}).repartition(5)
    got = [tuple(r) for r in shards_by_bytes(docs, shards).collect()]
    assert _sorted(got) == _sorted(_expected(rows, shards))


def test_one_text_in_most_rows_is_cut_evenly(spark):
    rows = [(k, "the same text again") for k in range(2000)] + [(None, None)] * 2000
    got = shards_by_bytes(spark.createDataFrame(rows, SCHEMA)).groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("slot").alias("slot")).collect()
    assert len(got) == 40 and all(r.slot == r.n - 1 for r in got)
    assert max(r.bytes for r in got) - min(r.bytes for r in got) <= 2 * 35


def test_rows_larger_than_a_share_stand_alone(spark):
    rows = [(1, "a" * 4_000_000), (2, "b" * 90_000)] + [(k, "c" * 100) for k in range(3, 400)]
    got = {r.doc_id: r for r in shards_by_bytes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[1].shard, got[2].shard) == (39, 38)
    assert sum(r.shard == 39 for r in got.values()) == sum(r.shard == 38 for r in got.values()) == 1
    assert {r.shard for r in got.values()} == set(range(40))
