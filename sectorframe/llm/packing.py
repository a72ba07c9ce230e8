"""Packing of token sequences into windows of one length by minimum bin slack.

A document's ids are cut into full windows and one rest. The rests are dealt at random to
bins of a bounded number of pieces. In a bin, each window is filled from the multiset of the
lengths that remain: a bitset holds the sums that can be reached, lengths are added from the
longest on, and when the fullest sum at or under the capacity is known, the lengths that make
it up (and how many of each) are traced back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder, with_end

CAPACITY = 2048
#: Pieces of a bin, on average: they are dealt by a hash, so no bin holds much more.
BIN_PIECES = 2000


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length make the sum closest to the capacity from below.

    lengths: those with a count over 0, descending. The first is always taken, so that long
    pieces don't remain to the end. The search stops once the capacity itself is reached.
    """
    first = lengths[0]
    reach, layers, mask = 1 << first, [], (1 << (capacity + 1)) - 1
    for length in lengths:
        n = counts[length] - (length == first)
        part = 1
        while n > 0 and not reach >> capacity & 1:  # counts by powers of two: n copies take log n shifts
            take = min(part, n)
            before = reach
            reach |= (reach << (take * length)) & mask
            if reach != before:
                layers.append((length, take, before))
            n -= take
            part *= 2
        if reach >> capacity & 1:
            break
    at, chosen = reach.bit_length() - 1, {first: 1}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            at -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def pack_lengths(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows as lists of positions in ``sizes``, each sum at most the capacity."""
    where: dict[int, list[int]] = {}
    for k, size in enumerate(sizes):
        where.setdefault(size, []).append(k)
    counts = {size: len(v) for size, v in where.items()}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        chosen = fullest(lengths, counts, capacity)
        window = []
        for length, n in sorted(chosen.items(), reverse=True):
            window += [where[length].pop() for _ in range(n)]
            counts[length] -= n
        lengths = [x for x in lengths if counts[x]]
        out.append(window)
    return out


def _cut(path: str, end: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(path, "words"), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for lo, hi, ids, counts in coder.chunks(batch.column("text")):
                ids, counts = with_end(ids, counts, end)
                ends = np.cumsum(counts)
                pieces = -(-counts // capacity)
                doc = np.repeat(np.arange(len(counts)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, counts[doc] - start)
                at = (ends - counts)[doc] + start
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                out = {
                    "doc_id": batch.column("doc_id").cast(pa.int64()).slice(lo, hi - lo).take(pa.array(doc)),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.int64()),
                    "doc_tokens": pa.array(counts[doc], pa.int64()),
                    "deal": pa.array((part << 40) + row + np.arange(len(doc)), pa.int64()),
                }
                if keep_ids:
                    out["ids"] = pa.array([ids[a : a + n] for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.list_(pa.int32()))
                row += len(doc)
                yield pa.RecordBatch.from_pydict(out)

    return run


def _fill(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values("deal", ignore_index=True)
        sizes = pieces["length"].to_numpy()
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k, window in enumerate(pack_lengths(sizes.tolist(), capacity)):
            own = sizes[window]
            sequence[window] = (int(pieces["bin"].iloc[0]) << 24) + k
            offset[window] = np.cumsum(own) - own
        return pieces.assign(sequence_id=sequence, offset=offset).drop(columns=["bin", "deal"])

    return run


def pack(docs: DataFrame, tokenizer: str, end: int = 1, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Pieces of every whole text with their place in a sequence: ``doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    docs: columns ``doc_id`` and ``text``; others are ignored. A null text is empty and has its
    end id only; null ids and repeated rows are kept, each row being a document of its own. An
    empty table gives no pieces. Sequences are shorter than the capacity only where the pieces
    left in a bin don't fill them.
    """
    columns = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, {}" + "ids array<int>, " * keep_ids
    schema = columns.format("deal bigint, ").rstrip(", ")
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, end, capacity, keep_ids), schema), "pieces")
    full = pieces.where(F.col("length") == capacity)
    rests = pieces.where(F.col("length") < capacity)
    bins = max(1, round(rests.count() / BIN_PIECES))
    dealt = rests.withColumn("bin", F.pmod(F.xxhash64("deal"), F.lit(bins)))
    packed = dealt.groupBy("bin").applyInPandas(_fill(capacity), columns.format("") + "sequence_id bigint, offset bigint")
    # A full piece is a sequence; its number is negative, so that it is none of a bin's.
    alone = full.withColumns({"sequence_id": -1 - F.col("deal"), "offset": F.lit(0).cast("bigint")}).drop("deal")
    return packed.unionByName(alone)
