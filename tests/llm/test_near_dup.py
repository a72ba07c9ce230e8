import re

import numpy as np
import pyarrow as pa
import pytest

from sectorframe.llm import near_dup
from sectorframe.llm.components import components, joined
from sectorframe.llm.words import NOT_BLANK, words

SCHEMA = "doc_id bigint, text string, n bigint, row bigint, tokens string"


def _set(text, width):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    return frozenset(zip(*[found[k:] for k in range(width)], strict=False)) if len(found) >= width else frozenset([tuple(found)])


def _brute(rows, width):
    sets = [_set(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    out = []
    for k, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None] if sets[k] else [doc]
        least = min(ids, default=None)
        out.append((doc, len(sets[k]), least, doc is not None and doc == least))
    return sorted(out, key=repr)


def _rows(seed, groups, copies):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choice(vocabulary, rng.integers(30, 80)).tolist()
        for _ in range(copies):
            own = list(base)
            for place in rng.integers(0, len(own), rng.integers(0, 5)):
                own[place] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(own)))
    return rows


ODD = [None, "", " \t\n", "one", "ONE", "one two", "One  two", "É é", "é É", "x " * 3000, "x " * 3001, "a b c d e", "a b c d e"]


@pytest.mark.parametrize("width,small,singly", [(2, 2048, 8), (5, 2048, 0), (2, 2048, 0)])
def test_components_equal_brute_force(spark, monkeypatch, width, small, singly):
    monkeypatch.setattr(near_dup, "SINGLY", singly)
    rows = _rows(width, 12, 12)
    rows += [(1000 + k if k % 4 else None, t) for k, t in enumerate(ODD)] + rows[:5]
    table = spark.createDataFrame([(d, t, 7, 7, "x") for d, t in rows], SCHEMA).repartition(3)
    got = near_dup.near_duplicates(table, width, small).collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, width)


def test_large_nodes_branch_on(spark, monkeypatch):
    """Nodes over the bound keep what is very like, and compare it with what is near."""
    rows = [(k, " ".join(f"w{j}" for j in range(60)) + f" x{k}") for k in range(60)] + [(100 + k, f"y{k} " * 9 + f"z{k} u v w") for k in range(9)]
    got = near_dup.near_duplicates(spark.createDataFrame([(d, t, 7, 7, "x") for d, t in rows], SCHEMA), 2, 4).collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows, 2)


def _shifted(triples):
    """Windows of 401 words, each 23 on from the last: neighbours are links at 0.89, the ends of three aren't at 0.794."""
    return [(3 * k + j, " ".join(f"t{k}w{i}" for i in range(23 * j, 23 * j + 401))) for k in range(triples) for j in range(3)]


def test_links_that_refuted_ones_seem_to_make_needless(spark):
    rows = _shifted(300)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
    assert all(r.component_id == r.doc_id - r.doc_id % 3 for r in got) and len(got) == 900


def test_each_pair_between_components_is_tried(spark, monkeypatch):
    """One node of all classes, whose forest is of no use: every link comes of the second look."""
    from pyspark.sql import functions as F

    def here(classes, small):
        open_ = classes.select(F.lit(1).cast("bigint").alias("node"), "k1").union(classes.where("k1 % 3 > 0").select(F.lit(2).cast("bigint"), "k1"))
        none = classes.where("false").select(F.col("k1").alias("a"), F.col("k1").alias("b"), F.lit(1).alias("alike"))
        return near_dup.Suggested(near_dup.stored(none, "none"), open_, None)

    monkeypatch.setattr(near_dup, "suggested", here)
    rows = _rows(5, 10, 14)
    for singly, block in ((10**9, 1 << 20), (0, 1 << 20), (0, 2000)):
        monkeypatch.setattr(near_dup, "SINGLY", singly)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), width=2).collect()
        assert sorted((tuple(r) for r in got), key=repr) == _brute(rows, 2)


def test_what_left_with_a_pivot_meets_what_is_near_it(spark):
    near = spark.createDataFrame([(2, 1, 95), (3, 1, 93), (4, 1, 70), (5, 1, 94), (6, 9, 95), (7, 1, -80)], "k1 bigint, p bigint, alike int")
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (6, 6), (9, 6)], "node bigint, root bigint")
    got = near_dup._two_sided(*near_dup._around(near, roots)).collect()
    assert len({r.node for r in got}) == 1 and sorted(r.k1 for r in got) == [1, 2, 3, 4, 5, 7]


def test_heaviest_forest():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 50_000, (5, 96)).astype(np.uint16)
    tokens = np.where(rng.random((60, 96)) < 0.12, rng.integers(0, 50_000, (60, 96)).astype(np.uint16), base[rng.integers(0, 5, 60)])
    i, j, weight, more = near_dup._forest(np.full(60, 100), tokens)
    equal = (tokens[:, None] == tokens).sum(2)
    edges = sorted(((equal[a, b], a, b) for a in range(60) for b in range(a) if equal[a, b] >= near_dup.LOW), reverse=True)
    root, total = list(range(60)), []
    for w, a, b in edges:
        if root[a] != root[b]:
            root = [root[b] if r == root[a] else r for r in root]
            total.append(w)
    assert sorted(weight.tolist()) == sorted(total) and (equal[i, j] == weight).all()
    assert set(more.tolist()) == {a for w, a, b in edges} | {b for w, a, b in edges}


def test_one_of_each_keeps_one_row(spark):
    rows = [(3, "a b c d e f g"), (1, "A b c d e f g"), (None, "a b c d e f g"), (1, "A b c d e f g"), (9, ""), (9, ""), (4, "other words here"), (5, None)]
    table = spark.createDataFrame([(d, t, 1, 1, "x") for d, t in rows], SCHEMA)
    got = near_dup.one_of_each(table, 2)
    assert got.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, "A b c d e f g"), (9, ""), (9, ""), (4, "other words here"), (5, None)], key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.one_of_each(empty).count() == 0


def test_long_chain_is_one_component(spark):
    order = np.random.default_rng(1).permutation(300).tolist()
    links = spark.createDataFrame([*zip(order, order[1:], strict=False), (1000, 1001), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(300), 0), 1000: 1000, 1001: 1000}


def test_further_links_join_components(spark):
    roots = components(spark.createDataFrame([(1, 2), (2, 3), (5, 6), (8, 9)], "a bigint, b bigint"))
    got = joined(roots, spark.createDataFrame([(3, 6), (7, 9), (20, 21)], "a bigint, b bigint"))
    assert {r.node: r.root for r in got.collect()} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 7, 20: 20, 21: 20}


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["ab ba", "", "AB\tx", " é\n", "ab" * 100]
    found = words(pa.array(texts), NOT_BLANK)
    assert np.diff(found.bounds).tolist() == [2, 0, 2, 1, 1]
    assert found.hashes[0] == found.hashes[2] != found.hashes[1] and len(set(found.hashes.tolist())) == 5


@pytest.mark.parametrize("size", [1, 4, 7, 1000])
def test_words_of_slices_are_those_of_whole_texts(monkeypatch, size):
    from sectorframe.llm import words as own

    texts = ["ab ba", "", "AB\tx", " é\n", "ab" * 300 + " z", "xyz", "", "w", "  ", "q" * 50]
    whole = words(pa.array(texts))
    monkeypatch.setattr(own, "SLICE", size)
    found = words(pa.array(texts))
    assert all((a == b).all() for a, b in zip(whole, found, strict=True))
    assert [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts] == np.diff(whole.bounds).tolist()


def _family(members, singles, size, seed):
    """Texts around one (0.85 to 0.9 to each other), and texts that have one link, to any one of those."""
    draw = np.random.default_rng(seed)

    def changed(text, places, tag):
        out = list(text)
        for k, place in enumerate(draw.choice(np.arange(1, size - 1), places, replace=False)):
            out[place] = f"{tag}x{k}"
        return out

    base = [f"w{k}" for k in range(size)]
    own = [changed(base, round(size * 0.0175), f"m{m}") for m in range(members)]
    single = [changed(own[draw.integers(members)], round(size * 0.053), f"s{s}") for s in range(singles)]
    return [(k, " ".join(t)) for k, t in enumerate([*own, *single])]


def test_single_links_into_a_large_family_stay(spark):
    """Nodes of four times the bound go on by one path; what a path loses is found beside the family."""
    rows = _family(260, 40, 400, 3)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 64)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(rows, 2)


def test_links_of_hubs_are_confirmed_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HUB", 3)
    monkeypatch.setattr(near_dup, "BLOCK", 2000)
    rows = _family(40, 20, 150, 5)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _brute(rows, 2)
