"""Licence scans: matching statistics of a generalised suffix automaton, chained into spans.

The automaton of all templates' words is small and built once in each worker. A text streams
through it: at each word it knows the longest run of words, ending there, that occurs in any
template. Long runs that extend no further are matches; for each template, matches in its
order and near each other are chained into a span with the words they cover.

Short matches are of no use, so only stretches of a text whose neighbouring words also
neighbour in a template are streamed; elsewhere no run reaches the least length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, text_column
from .words import ALPHANUMERIC, hash_of, words

#: Phrases whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Texts of public licences and notices, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("reserved", "All rights reserved."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
)

#: Words of a match, at least; also the words of the shortest template.
LEAST = 3
#: Words between matches of a chain, at most, in the text and in the template.
GAP = 8
#: Share of a template that a span covers, at least, to give its label.
COVERED = 0.6


def template_words(text: str) -> list[str]:
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


class Automaton:
    """Suffix automaton of several word sequences; each state knows where its runs end in them."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for k, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((k, place + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                ends[self.link[state]] = list({*ends[self.link[state]], *ends[state]})
        self.ends = [sorted(set(e)) for e in ends]

    def _clone(self, p: int, q: int, word: int, ends: list) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        ends.append([])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:  # another sequence has this run already
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, word, ends)
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        ends.append([])
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, word, ends)
        return new

    def matches(self, run: list[int]) -> list[tuple[int, int, int]]:
        """Matching statistics: (end in the run, length, state) of each place where the longest run stops growing."""
        out, state, length = [], 0, 0
        before = (0, 0, 0)
        for at, word in enumerate(run):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length <= before[1] and before[1] >= LEAST:
                out.append(before)
            before = (at + 1, length, state)
        if before[1] >= LEAST:
            out.append(before)
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES):
        texts = [template_words(t) for _, t in templates]
        self.labels, self.sizes = [name for name, _ in templates], [len(t) for t in texts]
        vocabulary = sorted({w for t in texts for w in t} | {w for p, _ in PHRASES for w in p.split()})
        hashes = np.array([hash_of(w) for w in vocabulary], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.vocabulary = hashes[order], [vocabulary[k] for k in order]
        number = {w: k for k, w in enumerate(self.vocabulary)}
        sequences = [[number[w] for w in t] for t in texts]
        self.automaton = Automaton(sequences)
        size = len(vocabulary) + 1
        self.pairs = np.zeros(size * size, bool)
        self.size = size
        for s in sequences:
            for a, b in zip(s, s[1:], strict=False):
                self.pairs[a * size + b] = True
        self.phrases = [(tuple(number[w] for w in p.split()), label) for p, label in PHRASES]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Words as numbers of the templates' vocabulary; others have the number after the last."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, self.size - 1)

    def spans(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """Chained spans of one text's word numbers: label, first word, word after the last, covered share."""
        if len(ids) < LEAST:
            return []
        ok = self.pairs[ids[:-1] * self.size + ids[1:]]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]])))
        found: dict[int, list[tuple[int, int, int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + 1 >= LEAST:
                for end, length, state in self.automaton.matches(ids[a : b + 1].tolist()):
                    for template, place in self.automaton.ends[state]:
                        found.setdefault(template, []).append((a + end - length, place - length, length))
        out = []
        for template, own in found.items():
            out += [(self.labels[template], a, b, c / self.sizes[template]) for a, b, c in self._chains(sorted(own))]
        return sorted(s for s in out if s[3] >= COVERED)

    def _chains(self, matches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
        """Each chain's first word, word after its last and words covered: every match joins the
        chain before it that covers most, among those near it in the text and the template."""
        live: list[list[int]] = []  # first word, end in the text, end in the template, covered
        for start, place, length in matches:
            for chain in [c for c in live if start - c[1] > GAP]:
                live.remove(chain)
                yield chain[0], chain[1], chain[3]
            best = None
            for chain in live:
                cut = max(0, chain[1] - start, chain[2] - place)
                if cut < length and place + cut - chain[2] <= GAP and start + length > chain[1] and place + length > chain[2] and (best is None or chain[3] - cut > best[0]):
                    best = (chain[3] - cut, chain, cut)
            if best:
                chain, cut = best[1:]
                chain[1:] = start + length, place + length, chain[3] + length - cut
            else:
                live.append([start, start + length, place + length, length])
        for chain in live:
            yield chain[0], chain[1], chain[3]


_SCANNER: list[Scanner] = []


def scan(docs: DataFrame, keep_spans: bool = True) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of each row of
    ``docs`` (``doc_id``, ``text``), with ``spans`` (label, first word, word after the last,
    covered share) if asked for.

    ``score`` is the largest covered share of a template, 0 without any. A null or empty text
    has no words, null first and last words, and empty labels; null ids and repeated rows are
    kept; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _SCANNER:
            _SCANNER.append(Scanner())
        scanner = _SCANNER[0]
        for batch in small_batches(batches, limit=2 << 20):
            found = words(text_column(batch), ALPHANUMERIC)
            ids, bounds = scanner.numbers(found.hashes), found.bounds
            n = batch.num_rows
            counts, first, last = np.zeros(n, np.int64), np.full(n, -1), np.full(n, -1)
            base: list[set[str]] = [set() for _ in range(n)]
            for phrase, label in scanner.phrases:
                width = len(phrase)
                hit = np.ones(max(0, len(ids) - width + 1), bool)
                for k, word in enumerate(phrase):
                    hit &= ids[k : len(ids) - width + 1 + k] == word
                at = np.flatnonzero(hit)
                doc = np.searchsorted(bounds, at, "right") - 1
                ok = at + width <= bounds[doc + 1]
                for d, w in zip(doc[ok].tolist(), (at - bounds[doc])[ok].tolist(), strict=True):
                    counts[d] += 1
                    first[d] = w if first[d] < 0 else min(first[d], w)
                    last[d] = max(last[d], w)
                    base[d].add(label)
            # A text is looked at more closely only if some stretch of it may hold a match.
            pair = scanner.pairs[ids[:-1] * scanner.size + ids[1:]] if len(ids) > 1 else np.zeros(0, bool)
            likely = np.zeros(n, bool)
            likely[np.searchsorted(bounds, np.flatnonzero(pair[:-1] & pair[1:]), "right") - 1] = True
            spans = [scanner.spans(ids[a:b]) if look else [] for a, b, look in zip(bounds[:-1].tolist(), bounds[1:].tolist(), likely.tolist(), strict=True)]
            out = {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_words": pa.array(np.diff(bounds), pa.int64()),
                "n_base": pa.array(counts, pa.int64()),
                "first_word": pa.array(first, pa.int64(), mask=first < 0),
                "last_word": pa.array(last, pa.int64(), mask=last < 0),
                "base_labels": pa.array([",".join(sorted(b)) for b in base], pa.string()),
                "labels": pa.array([",".join(sorted(b | {s[0] for s in own})) for b, own in zip(base, spans, strict=True)], pa.string()),
                "score": pa.array([max((min(1.0, s[3]) for s in own), default=0.0) for own in spans], pa.float64()),
            }
            if keep_spans:
                out["spans"] = pa.array([[{"label": s[0], "first": s[1], "end": s[2], "covered": s[3]} for s in own] for own in spans], pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", spans array<struct<label: string, first: bigint, end: bigint, covered: double>>" * keep_spans)
