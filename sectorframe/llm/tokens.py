"""Token ids of whole texts, by the public tokenizers' vocabulary files.

A text is cut at places where the tokenizer always cuts; each distinct piece of
a batch is encoded once, by the library, and the ids are put together with array
operations. The ids equal those of encoding the whole text (tests hold them
against that). Null texts count as empty.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes that the encoded pieces take which a Python worker keeps; when there would be more, those met in one chunk only go.
CACHE_BYTES = 64 << 20
#: Bytes of text that are encoded together; a longer text is encoded in parts of about this size.
CHUNK_BYTES = 1 << 20
#: Pieces that are given to the library in one string.
JOINED = 500
#: Bytes of a kept piece besides its text and ids: string, place in the table, two numbers.
_ENTRY = 180

_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SIGN = np.zeros(256, bool)
_SIGN[[ord(x) for x in _SIGNS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: White space beyond the blank and the line feed, and what might be taken for it.
_RARE = r"[\x00-\x09\x0b-\x1f\x7f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"

#: Bits that tell a byte's kind: blank, letter, sign (the next bit), and first byte of what ``_RARE`` finds.
_IS_BLANK, _IS_LETTER, _IS_SIGN, _IS_RARE = 1, 2, 4, 8
_KIND = _IS_LETTER * _LETTER.astype(np.uint8) + _IS_SIGN * _SIGN.astype(np.uint8)
_KIND[[ord(" "), ord("\n")]] = _IS_BLANK
_KIND[[*range(0, 10), *range(11, 32), 127, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = _IS_RARE

_CODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: str) -> Encoder:
    """The worker's encoder for a vocabulary file; ``cut`` is ``words`` or ``blanks``.

    ``words``: the tokenizer drops white space and lower-cases, so any blank is a cut.
    ``blanks``: a blank belongs to the word after it.
    """
    if (path, cut) not in _CODERS:
        _CODERS[path, cut] = Encoder(path, cut)
    return _CODERS[path, cut]


class Encoder:
    """One vocabulary in one Python worker. Not shared between processes."""

    def __init__(self, path: str, cut: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut = cut
        self._forget()
        self.marks = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.marks[k] = token.endswith("</w>") if cut == "words" else token[:1] in "ĠĊ"

    def _forget(self) -> None:
        """Kept pieces by number, in that order; the ids of number k stand in ``pool`` from ``starts[k]`` on, and ``met``
        tells how often a chunk held it."""
        self.known: dict[str, int] = {}
        self.held = 0
        self.starts = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.met = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def _thin(self) -> None:
        """Keep the pieces that chunks met again, the more often met of them where they would fill over half the room."""
        names = list(self.known)
        sizes = _ENTRY + 5 * np.fromiter(map(len, names), np.int64, len(names))
        least = 2
        while int(sizes[kept := np.flatnonzero(self.met >= least)].sum()) > CACHE_BYTES // 2:
            least *= 2
        pool, lengths = self._ids(kept)
        self.known = dict(zip(map(names.__getitem__, kept.tolist()), range(len(kept))))
        self.held = int(sizes[kept].sum())
        self.starts, self.lengths, self.met, self.pool = (np.cumsum(lengths) - lengths).astype(np.int32), lengths, self.met[kept] >> 1, pool

    def _ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of kept pieces one after another, and each one's count."""
        each = self.lengths[numbers]
        ends = np.cumsum(each, dtype=np.int64)
        where = np.repeat(self.starts[numbers] - (ends - each), each)
        where += np.arange(len(where))
        return self.pool[where], each

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.int32) for x in found]

    def _learn(self, pieces: list[str]) -> None:
        """Keep distinct pieces with their ids. Those that begin (or end) with a marked token and have
        no other go to the library many to a string."""
        simple = [x.isalpha() for x in pieces] if self.cut == "words" else [x[:1] in (" ", "\n") for x in pieces]
        many, rest = list(compress(pieces, simple)), list(compress(pieces, map(not_, simple)))
        groups = [many[i : i + JOINED] for i in range(0, len(many), JOINED)]
        ids, lengths = [], []
        for group, found in zip(groups, self._library([(" " if self.cut == "words" else "").join(g) for g in groups]), strict=True):
            at = np.flatnonzero(self.marks[found])
            if len(at) != len(group):
                one = self._library(group)
                ids += one
                lengths.append(np.array([len(x) for x in one], np.int64))
                continue
            ids.append(found)
            lengths.append(np.diff(at, prepend=-1) if self.cut == "words" else np.diff(at, append=len(found)))
        single = self._library(rest)
        lengths.append(np.array([len(x) for x in single], np.int64))
        before, each = len(self.known), np.concatenate(lengths)
        self.known.update(zip(many + rest, range(before, before + len(pieces))))
        self.starts = np.concatenate([self.starts, (len(self.pool) + np.cumsum(each) - each).astype(np.int32)])
        self.lengths = np.concatenate([self.lengths, each.astype(np.int32)])
        self.met = np.concatenate([self.met, np.zeros(len(pieces), np.int32)])
        self.pool = np.concatenate([self.pool, *ids, *single])

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(out < 0)
        if len(new):
            unknown = list(map(pieces.__getitem__, new.tolist()))
            fresh = list(dict.fromkeys(unknown))
            more = _ENTRY * len(fresh) + 5 * sum(map(len, fresh))
            if self.known and self.held + more > CACHE_BYTES:
                if self.held > CACHE_BYTES // 2:
                    self._thin()
                else:
                    self._forget()
                return self._numbers(pieces)
            self.held += more
            self._learn(fresh)
            out[new] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(new))
        self.met[out] += 1
        return out

    def _cut(self, texts: pa.Array, inner: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of all texts, the count of them in each text, and which texts are to be encoded whole. ``inner``: these
        are further parts of a text, which begin with a blank before a letter."""
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        kind = _KIND[data]
        blank = (kind & _IS_BLANK).view(bool)
        start = blank.copy()
        start[1:] |= (kind[:-1] << 1 & kind[1:] & _IS_SIGN).astype(bool)
        filled = np.flatnonzero(np.diff(bounds))

        def holding(here: np.ndarray) -> np.ndarray:
            """Numbers of the texts that hold a byte marked so."""
            return np.unique(np.searchsorted(bounds, np.flatnonzero(here), "right") - 1)

        start[bounds[filled]] = True
        odd = np.zeros(n, bool)
        if self.cut == "blanks":
            bad = np.zeros(len(data), bool)
            bad[1:] = blank[1:] & blank[:-1]
            if not inner:
                bad[bounds[filled]] |= blank[bounds[filled]]
            bad[bounds[filled + 1] - 1] |= blank[bounds[filled + 1] - 1]
            odd[np.searchsorted(bounds, np.flatnonzero(bad), "right") - 1] = True
            own = holding((kind & _IS_RARE).astype(bool))
            odd[own] |= pc.match_substring_regex(texts.take(own), _RARE).to_numpy(zero_copy_only=False)
        for content in self.added:  # the library takes it out of the text before anything is cut
            own = holding(data == ord(content[0])) if content[0] in _SIGNS else np.arange(n)
            odd[own] |= pc.match_substring(texts.take(own), content, ignore_case=True).to_numpy(zero_copy_only=False)
        if self.cut == "words":
            data = _LOWER[data]
        starts = np.flatnonzero(start)
        if self.cut == "words":
            # The blank itself goes to the piece before it, where the tokenizer drops it.
            data = np.where(blank, np.uint8(32), data)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        counts = np.diff(np.searchsorted(starts, bounds))
        return pieces, counts, odd

    def encode(self, texts: pa.Array, inner: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (int32), and each text's count of them; ``inner`` as in :meth:`_cut`."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts) or not pc.sum(pc.binary_length(texts)).as_py():
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        pieces, per_text, odd = self._cut(texts, inner)
        coded = pc.dictionary_encode(pieces)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = self._numbers([x.strip(" ") for x in distinct] if self.cut == "words" else distinct)[coded.indices.to_numpy()]
        out, each = self._ids(numbers)
        sums = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        last = np.cumsum(per_text)
        counts = sums[last] - sums[last - per_text]
        if odd.any():
            at = np.cumsum(counts) - counts
            parts = [out[a : a + c] for a, c in zip(at, counts, strict=True)]
            where = np.flatnonzero(odd)
            for k, x in zip(where, self._library(texts.take(pa.array(where)).to_pylist()), strict=True):
                parts[k], counts[k] = x, len(x)
            out = np.concatenate(parts)
        return out, counts

    def _long(self, text: pa.Scalar) -> np.ndarray:
        """Ids of one long text, by parts cut between a letter and the blank of a next word, where both kinds of
        tokenizer always cut and no added token can stand."""
        data = np.frombuffer(text.as_buffer(), np.uint8)
        cuts = [0]
        while len(data) - cuts[-1] > CHUNK_BYTES:
            at = cuts[-1] + CHUNK_BYTES
            while at < len(data) - 2:  # further on where a part has no such place
                own = data[at - CHUNK_BYTES // 8 : at + CHUNK_BYTES // 8]
                found = np.flatnonzero(_LETTER[own[:-2]] & (own[1:-1] == 32) & _LETTER[own[2:]])
                if len(found):
                    break
                at += CHUNK_BYTES // 8
            else:
                break
            cuts.append(at - CHUNK_BYTES // 8 + int(found[-1]) + 1)
        edges = pa.array([*cuts, len(data)], pa.int64())
        parts = pa.LargeStringArray.from_buffers(len(cuts), edges.buffers()[1], text.as_buffer())
        return np.concatenate([self.encode(parts.slice(k, 1), inner=k > 0)[0] for k in range(len(cuts))])

    def chunks(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """A column by CHUNK_BYTES: first row, row after the last, ids, counts."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, "right")))
            if sizes[to - 1] - before > CHUNK_BYTES:
                ids = self._long(texts[at])
                yield at, to, ids, np.array([len(ids)])
            else:
                yield at, to, *self.encode(texts.slice(at, to - at))
            at = to


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text."""
    return np.insert(ids, np.cumsum(counts), end), counts + 1
