"""Texts as sound: lossless 8-bit WAV files in a column, with spectral-peak fingerprints.

A payload is a text's UTF-8 bytes with zeros up to a positive multiple of 64. The wave module
writes it as mono samples of 8 bits into a table, whose stored bytes are read again for all
that follows. Features: short-time Fourier transforms with a window, a peak in each of three
bands of each frame where there is one, and pairs of a peak with those of the next frames as
codes of both bins and their distance, each with the time of its first frame.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, stored, text_column

UNIT = 64
RATE = 8000
FRAME, HOP = 256, 128
#: Bins of the three bands; bin 0, the mean, is none of them.
BANDS = ((1, 16), (16, 48), (48, FRAME // 2 + 1))
#: Frames after a peak's own in which it finds partners.
REACH = 2
#: A peak's least share of its frame's mean magnitude.
FLOOR = 1.5
#: Frames that are transformed together.
TOGETHER = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not mono samples of 8 bits")
        return w.readframes(w.getnframes())


def peaks(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The peak of each band in each frame of all payloads (frames x bands, -1 where a band has none), and each
    payload's frames. A band's strongest bin is a peak if it is over both its neighbours and over FLOOR times the
    frame's mean; silence has none. Frames are looked at TOGETHER at a time, whatever a payload's length."""
    frames = np.array([max(1, -(-max(0, len(p) - FRAME) // HOP) + 1) for p in payloads], np.int64)
    lengths = HOP * (frames - 1) + FRAME
    signal = np.frombuffer(b"".join(p.ljust(n, b"\x80") for p, n in zip(payloads, lengths.tolist(), strict=True)), np.uint8)
    begins = np.repeat(np.cumsum(lengths) - lengths - HOP * (np.cumsum(frames) - frames), frames) + HOP * np.arange(frames.sum())
    bins = np.full((len(begins), len(BANDS)), -1, np.int64)
    for a in range(0, len(begins), TOGETHER):
        rows = signal[begins[a : a + TOGETHER, None] + np.arange(FRAME)].astype(np.float32) - np.float32(128)
        power = np.abs(np.fft.rfft(rows * _WINDOW, axis=1))
        power = np.pad(power, ((0, 0), (0, 1)))  # a bin beyond the last, so that it has a neighbour
        floor, row = FLOOR * power.mean(1), np.arange(len(rows))
        for k, (lo, hi) in enumerate(BANDS):
            top = lo + power[:, lo:hi].argmax(1)
            most = power[row, top]
            bins[a : a + TOGETHER, k] = np.where((most > floor) & (most > power[row, top - 1]) & (most > power[row, top + 1]), top, -1)
    return bins, frames


def codes(bins: np.ndarray, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs of peaks, payload by payload: a pair's frame, first bin, second bin and distance in one
    number, ascending; and the count of each payload."""
    owner = np.repeat(np.arange(len(frames)), frames)
    time = np.arange(len(owner)) - np.repeat(np.cumsum(frames) - frames, frames)
    out, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for distance in range(REACH + 1):
        n = max(0, len(bins) - distance)
        for i in range(len(BANDS)):
            for j in range(i + 1 if distance == 0 else 0, len(BANDS)):
                at = np.flatnonzero((owner[:n] == owner[distance:]) & (bins[:n, i] >= 0) & (bins[distance:, j] >= 0))
                out.append((time[at] << 24) | (bins[at, i] << 14) | (bins[at + distance, j] << 4) | distance)
                owners.append(owner[at])
    found, owners = np.concatenate(out), np.concatenate(owners)
    order = np.lexsort((found, owners))
    return found[order], np.bincount(owners, minlength=len(frames))


def media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` of every row of ``docs`` (``doc_id``, ``text``), stored and read again.

    A null text is empty; null ids and repeated rows are kept; other columns are ignored; an empty table stays
    empty. A long text is one row of one file in the column, so a task holds it a few times over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [t.encode() for t in text_column(batch).to_pylist()]
            wavs = [to_wav(t + bytes(max(1, -(-len(t) // UNIT)) * UNIT - len(t))) for t in texts]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").cast(pa.int64()), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array(wavs, pa.binary())})

    return stored(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary"), "media")


def features(table: DataFrame, keep_codes: bool = True) -> DataFrame:
    """Digests and fingerprints of a table of media (``doc_id, n_bytes, media``).

    ``feature`` names the frames, the pairs and a digest of all time-coded pairs; ``codes``
    holds the pairs themselves, if asked for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            wavs = batch.column("media").to_pylist()
            payloads = [from_wav(w) for w in wavs]
            bins, frames = peaks(payloads)
            pairs, n_pairs = codes(bins, frames)
            edges = np.append(0, np.cumsum(n_pairs))
            digests = [hashlib.sha256(pairs[a:b].astype("<i8")).hexdigest()[:32] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            out = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": batch.column("n_bytes"),
                "payload_bytes": pa.array([len(p) for p in payloads], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                "tail_crc32": pa.array([zlib.crc32(p[-UNIT:]) for p in payloads], pa.int64()),
                "media_bytes": pa.array([len(w) for w in wavs], pa.int64()),
                "media_sha256": pa.array([hashlib.sha256(w).hexdigest() for w in wavs], pa.string()),
                "feature": pa.array([f"{n}:{c}:{d}" for n, c, d in zip(frames.tolist(), n_pairs.tolist(), digests, strict=True)], pa.string()),
            }
            if keep_codes:
                out["codes"] = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(pairs, pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", codes array<bigint>" * keep_codes
    return table.mapInArrow(run, schema)
