"""Token ids in files: a static range asymmetric numeral system with shared frequencies.

A shard row of the output holds whole documents in ascending ``doc_id`` order. Its ids are
cut into blocks of ``BLOCK`` ids, the last as long as is left. A block is dealt to ``LANES``
interleaved coders; its directory entry and states are a checkpoint (where its words begin,
each coder's state, a checksum of both), so that blocks decode alone and in any order.

Shards are rows of a Parquet table because Spark's writers and readers reach any store and
commit whole tasks only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, shared_dir, stored
from .tokens import encoder, with_end

#: Frequencies are scaled to a sum of 2 to this power; it exceeds the vocabulary.
BITS = 18
LANES = 32
BLOCK = 16384
#: Ids of a shard, at least, but for the last of a partition; a document is never split.
SHARD_IDS = 1 << 20
MAGIC = 0x534E4152

_LOW = np.uint64(1 << 32)
_BITS = np.uint64(BITS)
_ALL = np.uint64(1 << BITS)
_MASK = np.uint64((1 << BITS) - 1)
_WORD = np.uint64(32)


def scaled(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 for each id that occurs, as near the counts as that allows."""
    total = 1 << BITS
    out = np.zeros(len(counts), np.int64)
    here = np.flatnonzero(counts)
    if not len(here):
        return out
    if len(here) > total // 2:
        raise ValueError(f"{len(here)} ids don't fit frequencies of {BITS} bits")
    share = np.maximum(1, np.floor(counts[here] * ((total - len(here)) / counts.sum())).astype(np.int64))
    share[np.argmax(share)] += total - share.sum()
    if len(here) == 1:  # a frequency of the whole range would overflow; one slot stays unused
        share[0] = total - 1
    out[here] = share
    return out


class Coder:
    """Encodes and decodes blocks with one table of frequencies.

    A stored shard is a header (magic, ids, blocks, its own checksum), a directory (of each block its words and
    its checksum), the states, and the words. The header's checksum covers header and directory, a block's
    covers its states and words; so each stored byte is under one, and a block is checked alone.
    """

    def __init__(self, freq: np.ndarray):
        # One number for an id, and one for a slot, so that a step looks up once: a frequency in the lowest bits, then where
        # the id's slots begin (or a slot's place among them), then the slot's id.
        own, cum = freq.astype(np.uint64), (np.cumsum(freq) - freq).astype(np.uint64)
        self.table = own | cum << _BITS
        ids = np.repeat(np.arange(len(freq), dtype=np.uint64), freq)
        place = np.arange(len(ids), dtype=np.uint64) - np.repeat(cum, freq)
        self.slots = np.zeros(1 << BITS, np.uint64)
        self.slots[: len(ids)] = np.repeat(own, freq) | place << _BITS | ids << _BITS + _BITS

    def _push(self, grid: np.ndarray, last: int) -> tuple[np.ndarray, list[bytes]]:
        """States and words of blocks (steps x blocks x lanes); the last step has ids on ``last`` lanes only."""
        steps, blocks, _ = grid.shape
        grid = np.ascontiguousarray(grid, np.int64)
        x = np.full((blocks, LANES), _LOW, np.uint64)
        words = np.empty((steps, blocks, LANES), np.uint32)
        full = np.zeros((steps, blocks, LANES), bool)
        for s in range(steps - 1, -1, -1):
            n = last if s == steps - 1 else LANES
            found, own, out = self.table[grid[s, :, :n]], x[:, :n], full[s, :, :n]
            f = found & _MASK
            np.greater_equal(own, f << np.uint64(64 - BITS), out=out)
            words[s, :, :n] = own
            own = own >> (out * _WORD)
            x[:, :n] = own + own // f * (_ALL - f) + (found >> _BITS)
        return x, [words[:, k][full[:, k]].astype("<u4").tobytes() for k in range(blocks)]

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        whole, rest = divmod(n, BLOCK)
        states, words = self._push(ids[: whole * BLOCK].reshape(whole, -1, LANES).transpose(1, 0, 2), LANES) if whole else (np.zeros((0, LANES), np.uint64), [])
        if rest:
            padded = np.zeros(-(-rest // LANES) * LANES, ids.dtype)
            padded[:rest] = ids[whole * BLOCK :]
            x, more = self._push(padded.reshape(-1, 1, LANES), (rest - 1) % LANES + 1)
            states, words = np.concatenate([states, x]), words + more
        states = states.astype("<u8")
        directory = np.array([[len(w) // 4, zlib.crc32(w, zlib.crc32(x.tobytes()))] for w, x in zip(words, states, strict=True)], "<u4").tobytes()
        head = np.array([MAGIC, n, len(words)], "<u4").tobytes()
        return b"".join([head, np.array([zlib.crc32(directory, zlib.crc32(head))], "<u4").tobytes(), directory, states.tobytes(), *words])

    def _pull(self, x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (blocks x steps * lanes) and where the words of each block end; raises unless all coders end as they began."""
        grid = np.zeros((steps, len(x), LANES), np.uint32)
        for s in range(steps):
            n = last if s == steps - 1 else LANES
            own = x[:, :n]
            found = self.slots[(own & _MASK).view(np.int64)]
            grid[s, :, :n] = found >> _BITS + _BITS
            own = (found & _MASK) * (own >> _BITS) + (found >> _BITS & _MASK)
            low = own < _LOW
            # The words of a step stand lane after lane in each block.
            lanes = np.flatnonzero(low)
            taken = np.diff(lanes.searchsorted(np.arange(len(x) + 1) * n))
            where = np.repeat(at - (np.cumsum(taken) - taken), taken)
            where += np.arange(len(lanes))
            flat = own.ravel()
            flat[lanes] = flat[lanes] << _WORD | words.take(where, mode="clip")
            x[:, :n] = flat.reshape(own.shape)
            at = at + taken
        if (x != _LOW).any():
            raise ValueError("coders don't end as they began")
        return grid.transpose(1, 0, 2).reshape(len(x), -1), at

    def decode(self, data: bytes, only: range | None = None) -> np.ndarray:
        """All ids, or those of the blocks ``only``; raises if a checksum, a word count or a final state is wrong."""
        if len(data) < 16:
            raise ValueError("not a shard")
        magic, n, blocks, check = (int(v) for v in np.frombuffer(data, "<u4", 4))
        first = 16 + 8 * blocks
        if magic != MAGIC or blocks != -(-n // BLOCK) or len(data) < first + 8 * blocks * LANES or zlib.crc32(data[16:first], zlib.crc32(data[:12])) != check:
            raise ValueError("not a shard, or its directory is damaged")
        directory = np.frombuffer(data, "<u4", 2 * blocks, 16).reshape(-1, 2).astype(np.int64)
        states = np.frombuffer(data, "<u8", blocks * LANES, first).reshape(-1, LANES)
        begin = first + 8 * blocks * LANES
        ends = np.cumsum(directory[:, 0])
        if len(data) != begin + 4 * (int(ends[-1]) if blocks else 0):
            raise ValueError("a shard of another length than its directory says")
        which = range(blocks)[only.start : only.stop] if only is not None else range(blocks)
        for k in which:
            raw = memoryview(data)[begin + 4 * int(ends[k] - directory[k, 0]) : begin + 4 * int(ends[k])]
            if zlib.crc32(raw, zlib.crc32(states[k].tobytes())) != directory[k, 1]:
                raise ValueError(f"checksum of block {k}")
        words = np.append(np.frombuffer(data, "<u4", -1, begin), np.uint32(0)).astype(np.uint64)
        out = []
        for own, size in ((which if n % BLOCK == 0 else range(which.start, min(which.stop, blocks - 1)), BLOCK), (range(max(which.start, blocks - 1), which.stop) if n % BLOCK else range(0), n % BLOCK)):
            if len(own):
                at = slice(own.start, own.stop)
                ids, to = self._pull(states[at].copy(), words, ends[at] - directory[at, 0], -(-size // LANES), (size - 1) % LANES + 1)
                if (to != ends[at]).any():
                    raise ValueError("words are left over")
                out.append(ids[:, :size].ravel())
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _check(start: int, doc_ids: pa.Array, counts: np.ndarray) -> int:
    """Checksum of what a shard row holds besides its ids."""
    known = np.asarray(doc_ids.is_valid())
    raw = [np.array([start, len(counts)], "<i8"), known, doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), counts.astype("<i8")]
    out = 0
    for x in raw:
        out = zlib.crc32(np.ascontiguousarray(x).tobytes(), out)
    return out


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(path, "blanks"), TaskContext.get().partitionId()
        if max(coder.tokenizer.get_vocab_size(), end + 1) > 1 << 16:
            raise ValueError("ids over 65,535")
        docs, counts, ids, seq, before, held = [], [], [], 0, 0, 0

        def shard() -> pa.RecordBatch:
            each = np.concatenate(counts)
            all_ids = np.concatenate(ids).astype("<u2")
            return pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": pa.array([before], pa.int64()), "n_ids": pa.array([len(all_ids)], pa.int64()),
                 "doc_ids": pa.array([pa.concat_arrays(docs)], pa.list_(pa.int64())), "counts": pa.array([each], pa.list_(pa.int64())), "ids": pa.array([all_ids.tobytes()], pa.binary())}
            )

        for batch in batches:
            for lo, hi, found, each in coder.chunks(batch.column("text")):
                found, each = with_end(found, each, end)
                docs.append(batch.column("doc_id").cast(pa.int64()).slice(lo, hi - lo))
                counts.append(each)
                ids.append(found.astype(np.uint16))
                held += len(found)
                if held >= SHARD_IDS:
                    yield shard()
                    docs, counts, ids, seq, before, held = [], [], [], seq + 1, before + held, 0
        if docs:
            yield shard()

    return run


_SHARD = "part int, seq int, before bigint, n_ids bigint, doc_ids array<bigint>, counts array<bigint>, ids binary"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for ids in batch.column("ids"):
            total += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=len(total))
    here = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(here, pa.int32()), "n": pa.array(total[here], pa.int64())})


def write(docs: DataFrame, tokenizer: str, end: int = 0, path: str | None = None) -> str:
    """Encode every whole text and write shards and the shared table of frequencies.

    docs: columns ``doc_id`` and ``text``; others are ignored. Null texts are empty; a null
    ``doc_id`` comes first; rows with one ``doc_id`` stand by their text, and repeated rows
    are all written. An empty table gives no shards. Returns the folder, which holds
    ``shards`` and ``frequencies``. A vocabulary or end id over 65,536 ids raises. A text of any
    length is one document of one shard, so its ids are held whole by a task (two bytes each).

    The driver gets the frequencies (one row for an id of the vocabulary) and one count for
    a shuffle partition.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/rans-{abs(hash((id(docs), tokenizer)))}-{np.random.default_rng().integers(1 << 60)}"
    rows = docs.select("doc_id", "text")
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    tokens = stored(ordered.mapInArrow(_tokenise(tokenizer, end), _SHARD), "rans-ids")
    found = tokens.select("ids").mapInArrow(_frequencies, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    table = stored(found, "rans-n").toPandas()
    counts = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.int64)
    counts[table["id"].to_numpy(np.int64)] = table["n"].to_numpy(np.int64)
    freq = scaled(counts)
    parts = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    first = dict(zip([p for p, _ in parts], np.cumsum([0, *(n for _, n in parts)])[:-1].tolist(), strict=True))
    freq_bytes = freq.astype("<i4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(freq_bytes, "<i4").astype(np.int64))
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                data = coder.encode(np.frombuffer(one.column("ids")[0].as_buffer(), "<u2"))
                start = first[one.column("part")[0].as_py()] + one.column("before")[0].as_py()
                check = _check(start, one.column("doc_ids")[0].values, one.column("counts")[0].values.to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_pydict({"start": pa.array([start], pa.int64()), "doc_ids": one.column("doc_ids"), "counts": one.column("counts"), "check": pa.array([check], pa.int64()), "data": pa.array([data], pa.binary())})

    spark.createDataFrame([(freq_bytes,)], "freq binary").coalesce(1).write.parquet(f"{path}/frequencies")
    tokens.select("part", "before", "doc_ids", "counts", "ids").mapInArrow(encode, "start bigint, doc_ids array<bigint>, counts array<bigint>, check bigint, data binary").write.option("compression", "none").parquet(f"{path}/shards")
    dropped(tokens)
    return path


def read(spark, path: str, keep_ids: bool = True) -> DataFrame:
    """Documents of a written folder: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.

    ``start``: ids of all documents before; the end id counts in ``n_tokens``.
    """
    freq_bytes = bytes(spark.read.parquet(f"{path}/frequencies").head().freq)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(np.frombuffer(freq_bytes, "<i4").astype(np.int64))
        for batch in batches:
            for k in range(batch.num_rows):
                ids = coder.decode(batch.column("data")[k].as_py())
                counts = batch.column("counts")[k].values.to_numpy(zero_copy_only=False)
                ends = np.cumsum(counts)
                start, docs = batch.column("start")[k].as_py(), batch.column("doc_ids")[k].values
                if _check(start, docs, counts) != batch.column("check")[k].as_py() or (ends[-1] if len(ends) else 0) != len(ids):
                    raise ValueError("checksum of a shard's documents")
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                spans = [(4 * int(b - n), 4 * int(b)) for b, n in zip(ends, counts, strict=True)]
                out = {
                    "doc_id": docs,
                    "start": pa.array(start + ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64()),
                }
                if keep_ids:
                    out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return spark.read.parquet(f"{path}/shards").mapInArrow(decode, schema)
