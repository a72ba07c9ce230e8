import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sectorframe.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, target int"


def _targets(sizes, weights, most):
    """By repeated sharing: what is over a cap goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, out, free = float(sum(sizes.values())), {}, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
        if not free:
            return out


def _table(spark, rows):
    return spark.createDataFrame([(d, t, s, "x", 1) for d, t, s in rows], SCHEMA).repartition(3)


def _rows(seed=0, n=900):
    rng = np.random.default_rng(seed)
    sources = ["b", "a", None, "", "é", "zz", "tiny"]
    p = [0.5, 0.2, 0.1, 0.1, 0.05, 0.045, 0.005]
    return [(k, "w " * int(rng.pareto(1.5) * 8 + 1), sources[rng.choice(7, p=p)]) for k in range(n)]


def test_targets_and_taken(spark):
    rows = _rows()
    got = mixing.mixed_sizes(_table(spark, rows)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(re.findall(mixing.WORD, t))
    aims = _targets(dict(sizes), (5, 2, 1), 3)
    by_id = {d: s for d, _, s in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and np.isclose(r.target, aims[s])
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3 and r.copies in (int(aims[s] / sizes[s]), int(aims[s] / sizes[s]) + 1)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert np.isclose(sum(aims.values()), sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - aims[s]) <= largest[s] / 2 + 1e-6, s
    assert len(got) == len(rows)


def test_reruns_agree(spark):
    rows = _rows(1, 300)
    a, b = (sorted(map(tuple, mixing.mixed_sizes(_table(spark, rows[::step])).collect())) for step in (1, -1))
    assert a == b


def test_each_document_is_as_likely(spark):
    """Over seeds, copies average to the share that is due."""
    rows = [(k, "w " * (1 + k % 5), "ab"[k % 2]) for k in range(60)]
    table = _table(spark, rows).cache()
    mean = Counter()
    for seed in range(12):
        for r in mixing.mixed_sizes(table, seed=seed).collect():
            mean[r.doc_id] += r.copies / 12
    due = {"a": 5 / 7 * 2, "b": 2 / 7 * 2}
    assert all(abs(np.mean([mean[d] for d, _, s in rows if s == source]) - due[source]) < 0.1 for source in "ab")


def test_repeated_rows_nulls_and_empty_texts(spark):
    rows = [(1, "a b", "x")] * 50 + [(None, "a b", "x")] * 7 + [(2, None, "x"), (3, "", "y"), (4, "c", None), (5, " ", None)]
    got = mixing.mixed_sizes(_table(spark, rows)).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((d, len(re.findall(mixing.WORD, t or ""))) for d, t, _ in rows)
    assert all(r.copies <= 3 for r in got)
    mixed = mixing.mix(_table(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "size", "target"]
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in Counter(x for r in got for x in [r.doc_id] * r.copies).items()})
    assert mixing.mixed_sizes(_table(spark, [])).count() == 0 and mixing.mix(_table(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 65, 700])
def test_tree_of_any_depth(spark, n):
    rows = [(k, "w " * (k % 9 + 1), "s" if k % 3 else "t") for k in range(n)]
    got = mixing.mixed_sizes(_table(spark, rows), block=4).collect()
    by = defaultdict(int)
    for r in got:
        by[r.target] += r.taken
    assert all(abs(v - k) <= 5 for k, v in by.items())


def test_many_rows_without_id_and_text(spark):
    n = 3 * mixing.RUN + 5
    rows = spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("a").alias("source"))
    named = spark.createDataFrame([(k, "one two three", "a") for k in range(7)], "doc_id bigint, text string, source string")
    got = mixing.mixed_sizes(rows.union(named)).groupBy("doc_id", "size").agg(F.count("*").alias("n"), F.sum("taken").alias("taken")).collect()
    assert sorted((r.doc_id is None, r["size"], r.n, r.taken) for r in got) == [(False, 3, 1, 3)] * 7 + [(True, 0, n, 0)]


def test_rows_of_a_hot_item_are_ranked_in_parts(spark, monkeypatch):
    """Without id, with equal and with different texts: each row has its even share, and all further columns."""
    monkeypatch.setattr(mixing, "RUN", 50)
    n = 900
    text = F.when(F.col("id") % 3 == 0, F.lit("same words")).otherwise(F.concat(F.lit("word "), F.col("id").cast("string")))
    hot = spark.range(n, numPartitions=5).select(F.lit(None).cast("bigint").alias("doc_id"), text.alias("text"), F.lit(None).cast("string").alias("source"), F.col("id").alias("_k"), F.create_map(F.lit("a"), "id").alias("_row"))
    few = spark.range(120).select("id", F.lit("one two three").alias("text"), F.lit("a").alias("source"), (F.col("id") + n).alias("_k"), F.create_map(F.lit("b"), "id").alias("_row"))
    docs = hot.union(few.withColumnRenamed("id", "doc_id"))
    parts = docs.groupBy("doc_id", "source").count().agg(F.max("count")).head()[0]
    assert parts > max(mixing.RUN, docs.count() // mixing.HOT)
    got = mixing.mix(docs).collect()
    times = Counter(r["_k"] for r in got)
    total = mixing.copies(docs).where("doc_id IS NULL").head().total
    assert sum(times[k] for k in range(n)) == total and {times[k] for k in range(n)} <= {total // n, total // n + 1}
    assert all(r["_row"] == ({"a": r["_k"]} if r["_k"] < n else {"b": r["_k"] - n}) for r in got)
    sizes = mixing.mixed_sizes(docs).groupBy("doc_id").agg(F.sum("copies").alias("c")).collect()
    assert {r.doc_id: r.c for r in sizes if r.c} == dict(Counter(r.doc_id for r in got))


def test_a_hot_item_is_mixed_alike_from_any_files(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 50)
    hot = spark.range(600).select(F.lit(None).cast("bigint").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"), F.lit("a").alias("source"))
    docs = hot.union(spark.range(90).select("id", F.lit("one two three").alias("text"), F.lit("b").alias("source")))
    one, other = (Counter(tuple(r) for r in mixing.mix(docs.repartition(n, F.xxhash64("text", F.lit(n)))).collect()) for n in (2, 5))
    assert one == other
