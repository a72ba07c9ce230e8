"""The manifest against trees grown level by level, with whole paths."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sectorframe.llm.merkle import Frontier, folded, joined, manifest, without_line_ends

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def _h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def _levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([_h(levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    return levels


def _path(levels, i):
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        yield i % 3, [x for k, x in enumerate(run) if k != i % 3]
        i //= 3


def _expected(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for own in sources.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = {s: _levels([_leaf(r) for r in sources[s]]) for s in names}
    top = _levels([trees[s][-1][0] for s in names])
    for n, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            path = [*_path(trees[s], i), *_path(top, n)]
            h = _leaf((*r[:4], r[4].replace("\n", "")) if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r)
            for place, others in path:
                h = _h([*others[:place], h, *others[place:]])
            yield r[0], _leaf(r), trees[s][-1][0], top[-1][0], _h(x for _, others in path for x in others), h, h == top[-1][0]


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize(("n", "depth", "sources"), [(0, 1, 3), (1, 1, 1), (5, 1, 3), (300, 1, 9), (300, 2, 40), (300, 8, 3)])
def test_manifest_equals_whole_trees(spark, n, depth, sources):
    """Nulls in all columns, empty texts, repeated ids and rows, one hot source, trees of several levels of blocks."""
    draw = random.Random(n + depth)
    rows = []
    for _ in range(n):
        source = draw.choice(["hot", draw.choice([None, "", "é", *map(str, range(sources))])])
        text = draw.choice([None, "", "a\nb", "x\n" * 50, "q", "\n"])
        rows.append((draw.choice([None, 7, *[draw.randrange(10**6)] * 8]), source, draw.choice([None, "en"]), draw.choice([None, 3]), text))
    rows += rows[:3]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("node", F.lit("x"))
    got = [tuple(r) for r in manifest(docs, without_line_ends(), depth).collect()]
    assert _sorted(got) == _sorted(_expected(rows))


def test_one_source_in_one_tree(spark):
    rows = [(k, "only", "en", k, f"text {k}\n") for k in range(28)]
    got = [tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA), None, 1).collect()]
    assert all(r[6] and r[2] == r[3] for r in got)
    assert {r[1] for r in got} == {_leaf(r) for r in rows}


def test_a_long_text(spark):
    rows = [(1, "a", None, None, "ab\n" * (3 << 20)), (2, "a", None, None, "b")]
    got = [tuple(r) for r in manifest(spark.createDataFrame(rows, SCHEMA), without_line_ends()).collect()]
    assert _sorted(got) == _sorted(_expected(rows))


@pytest.mark.parametrize("n", range(1, 31))
def test_witnesses_grow_as_siblings_complete(n):
    nodes = [sha256(bytes([k])).digest() for k in range(n)]
    tree = Frontier()
    for k, node in enumerate(nodes):
        tree.append(node)
        # Leaves of whole runs hold both siblings, those of an open run the ones seen so far.
        assert [len(w) for w in tree.seen[0]] == [2] * (k - k % 3) + [k % 3] * (k % 3 + 1)
    root, witnesses = tree.closed()
    level = nodes
    while len(level) > 1:
        level = [joined(level[k : k + 3]) for k in range(0, len(level), 3)]
    assert root == level[0]
    assert all(folded(x, k, n, w) == root for k, (x, w) in enumerate(zip(nodes, witnesses, strict=True)))
