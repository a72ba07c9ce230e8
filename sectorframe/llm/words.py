"""Words of many texts at once, as places in a buffer of bytes and as 64-bit hashes.

The texts of an Arrow column stand one after another in one buffer. A word is a longest run
of the bytes of one class, and its hash is a sum over its bytes of a random number of the byte
times a power for its place in the word, mixed at the end. Equal words have equal hashes;
different ones differ but for about 1 in 2**60 pairs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: All bytes but white space: [^\x20\x09-\x0D]
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Digits, lower-case letters and all bytes above ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C13
#: Bytes that are looked at together.
SLICE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose outputs look random."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS = np.zeros(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if n > len(_POWERS):
        more = np.full(2 * n, _BASE, np.uint64)
        more[0] = 1
        _POWERS = np.cumprod(more)
    return _POWERS


class Words(NamedTuple):
    data: np.ndarray  # lower-cased bytes of all texts
    starts: np.ndarray  # of words, in data
    lengths: np.ndarray  # of words, in bytes
    hashes: np.ndarray
    bounds: np.ndarray  # words of text k: bounds[k] to bounds[k + 1]


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column without nulls, and where each begins."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if n else np.zeros(0, np.uint8)
    return data, ends - ends[0] if n else np.zeros(1, np.int64)


def words(texts: pa.Array, kind: np.ndarray = NOT_BLANK, lower: bool = True) -> Words:
    """The words of whole texts, found slice by slice: beyond the bytes and the words themselves, memory doesn't
    grow with a text. A word over the end of a slice goes on in the next."""
    data, bounds = buffer(texts)
    if lower:
        data = _LOWER[data]
    starts, lengths, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    goes_on = False
    for a in range(0, len(data), SLICE):
        own = data[a : a + SLICE]
        inside = kind[own]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        cuts = bounds[np.searchsorted(bounds, a) : np.searchsorted(bounds, a + len(own))] - a  # texts that begin here
        start[cuts] = inside[cuts]
        first = np.flatnonzero(start)
        if not len(first):
            goes_on = False
            continue
        of = np.cumsum(start)[inside] - 1
        place = np.flatnonzero(inside) - first[of]
        n = np.bincount(of, minlength=len(first))
        total = np.add.reduceat(_OF_BYTE[own[inside]] * _powers(int(n.max()))[place], np.cumsum(n) - n)
        if goes_on and first[0] == 0 and not (len(cuts) and cuts[0] == 0):
            before = int(lengths[-1][-1])
            sums[-1][-1] = (int(sums[-1][-1]) + pow(_BASE, before, 1 << 64) * int(total[0])) % (1 << 64)
            lengths[-1][-1] = before + n[0]
            first, n, total = first[1:], n[1:], total[1:]
        if len(first):
            starts.append(first + a)
            lengths.append(n)
            sums.append(total)
        goes_on = bool(inside[-1])
    starts, lengths, sums = (np.concatenate(x) for x in (starts, lengths, sums))
    return Words(data, starts, lengths, mix(sums + lengths.astype(np.uint64)), np.searchsorted(starts, bounds))


def hash_of(word: str) -> int:
    return int(words(pa.array([word]), np.ones(256, bool), lower=False).hashes[0])


def shingles(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct runs of ``width`` words as sorted hashes, one text after another,
    and where each text's begin. A text of fewer words has its whole sequence as one; one
    without words has none."""
    n = len(found.bounds) - 1
    counts = np.diff(found.bounds)
    total = len(found.hashes)
    sums = found.hashes.copy()
    for k in range(1, width):
        sums[: total - k] = mix(sums[: total - k] * np.uint64(0x9E3779B97F4A7C15) + found.hashes[k:])
    text = np.repeat(np.arange(n), counts)
    last = np.arange(total) + width <= found.bounds[1:][text]
    values, owner = sums[last], text[last]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = []
        for k in short:
            h = np.array([0x5851F42D4C957F2D], np.uint64)
            for w in found.hashes[found.bounds[k] : found.bounds[k + 1]]:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + w)
            extra.append(h[0])
        values, owner = np.append(values, np.array(extra, np.uint64)), np.append(owner, short)
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    edges = np.searchsorted(owner, np.arange(n + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values), np.append(0, np.cumsum(sizes))
