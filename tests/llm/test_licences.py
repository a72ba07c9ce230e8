import re

import numpy as np

from sectorframe.llm import licences

SCHEMA = "doc_id bigint, text string, labels string, n_words int"


def _base(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(k, label) for phrase, label in licences.PHRASES for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return len(found), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_base_places_and_labels(spark):
    mit = licences.TEMPLATES[5][1]
    texts = [None, "", "...", "MIT-License mit license", "the mit", "license", "a GNU General\nPublic LICENSE, x Apache License", "É MIT license é", "x " * 400 + mit + " y" * 50, mit.replace("free of charge", "at no cost"), "All rights reserved.", "under CC BY-NC 4.0. licensed", "Licensed under CC BY-NC 4.0.", "mit mit license license mit license"]
    rows = [(None if k == 4 else k, t, "clash", 1) for k, t in enumerate(texts)] * 2
    got = licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for k, text in enumerate(texts):
        r = by_id[None if k == 4 else k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _base(text), text
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by_id[8].labels == "mit" and by_id[8].score == 1 and by_id[8].spans[-1].first == 400
    assert by_id[9].labels == "mit" and 0.9 < by_id[9].score < 1
    assert by_id[10].labels == "reserved" and by_id[12].labels == "cc-by-nc"
    assert licences.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(3)
    sequences = [rng.integers(0, 4, 30).tolist() for _ in range(4)]
    automaton = licences.Automaton(sequences)
    runs = {tuple(s[a:b]): set() for s in sequences for a in range(30) for b in range(a + 1, 31)}
    for k, s in enumerate(sequences):
        for a in range(30):
            for b in range(a + 1, 31):
                runs[tuple(s[a:b])].add((k, b))
    for _ in range(50):
        text = rng.integers(0, 5, 40).tolist()
        longest = [max((n for n in range(1, e + 1) if tuple(text[e - n : e]) in runs), default=0) for e in range(1, 41)]
        expected = [(e + 1, n) for e, n in enumerate(longest) if n >= licences.LEAST and (e == 39 or longest[e + 1] <= n)]
        got = automaton.matches(text)
        assert [(e, n) for e, n, _ in got] == expected
        for e, n, state in got:
            assert set(automaton.ends[state]) == runs[tuple(text[e - n : e])]
