"""Near-duplicates of whole texts by chosen paths.

A text's set holds its distinct word shingles. Texts of equal sets form a class, which goes
on as one. In each of several independent trees a class follows a path: a node picks some of
the minwise tokens at random (a root two), and the class goes to the child that belongs to its
own tokens there. Nodes of a bounded number of classes are compared exhaustively, by signature.
In a larger node all are compared with a few pivots, those very like one leave (their link to it
stays), and the rest branches on, until all nodes are small: by as many paths as keep a link at the
threshold, or, where most of the node is alike so that this would be very many, by one.

What signatures suggest is confirmed on the full sets, so that a group of many near copies needs
no row for each of its pairs. A node tells the heaviest spanning forest of its pairs; full sets
confirm each class's best link, then those that still join different components. With the components
known, nodes that hold several and have pairs beyond their forest are compared once more, and every
pair between two components is tried on full sets, singly or, where there are many, set by set in
blocks. What left with a pivot is compared like that with all that is near the pivot and not joined
to it. Of a large node that went on by one path, what isn't in its largest component is compared with
all of that component, and with each other. So each pair of like signatures that stood in a small node,
or in one that went on by one path, is joined by confirmed links, or refuted.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, guarded, small_batches, stored, text_column
from .components import components, joined
from .words import mix, shingles, words

#: Minwise tokens of a signature.
TOKENS = 96
TREES = 16
#: Classes of a node that are compared exhaustively, at most; pivots of a larger node.
SMALL, PIVOTS = 2048, 16
#: Equal tokens: of a link at similarity 0.8 there are fewer than LOW (not seen) once in 45,000; a pair with ALIKE
#: is a link all but surely, and what is linked to it has NEAR with its pivot, but for one in thousands.
LOW, ALIKE, NEAR = 60, 92, 56
#: A large node whose pivots have more than this share of equal tokens goes on by one path.
ONE_PATH = 0.8
#: Links of one class whose sets meet pair by pair, at most; beyond, its set is sent once for many of them.
HUB = 64
#: Classes of a block of a component that meets others, at most.
MANY = 4096
#: Pairs for each class of a node that are told singly, at most; beyond, its sets come together.
SINGLY = 2
#: Shingles of a block of sets, about, and sets of a shingle that is counted pair by pair, at most.
BLOCK, FEW = 1 << 20, 16
#: Bits of the filter by which the texts of suggested links are found again: 4 MB, whatever the number of texts.
FILTER_WORDS = 1 << 19

#: Bits of a node's number that tell its tree.
_TREE_BITS = np.uint64(6)

_random = np.random.Generator(np.random.PCG64(20))
_TIMES = (_random.integers(0, 1 << 32, TOKENS) | 1).astype(np.uint32)
_PLUS = _random.integers(0, 1 << 32, TOKENS).astype(np.uint32)


def _sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, where each text's begin, and two hashes of each set."""
    values, edges = shingles(words(text_column(batch)), width)
    keys = []
    for salt in (0x1234567, 0x89ABCDEF):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
        keys.append(mix(sums[edges[1:]] - sums[edges[:-1]] + (edges[1:] - edges[:-1]).astype(np.uint64)).view(np.int64))
    return values, edges, *keys


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            values, edges, k1, k2 = _sets(batch, width)
            sizes = np.diff(edges)
            filled = np.flatnonzero(sizes)
            tokens = np.zeros((batch.num_rows, TOKENS), np.uint16)
            if len(filled):
                low = (values >> np.uint64(32)).astype(np.uint32)
                for k in range(TOKENS):
                    least = np.minimum.reduceat(low * _TIMES[k] + _PLUS[k], edges[:-1][filled])
                    tokens[filled, k] = mix(least).astype(np.uint16)
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * TOKENS), batch.num_rows, [None, pa.py_buffer(tokens)]).cast(pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "n": pa.array(sizes, pa.int64()), "k1": pa.array(k1), "k2": pa.array(k2), "tokens": data})

    return run


def _tokens(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TOKENS)


def _path(seed: np.ndarray, tokens: np.ndarray, places: Sequence[int]) -> np.ndarray:
    """The children that belong to tokens at some places; ``seed`` is the node's, the same for all classes there."""
    child = np.full(len(tokens), seed)
    for place in places:
        child = mix(child * np.uint64(0x9E3779B97F4A7C15) + tokens[:, place].astype(np.uint64) + np.uint64(1))
    return child


def _picks(seed: np.uint64, n: int) -> list[int]:
    """``n`` places that a node picks."""
    return [int(x) for x in mix(seed + np.arange(1, n + 1, dtype=np.uint64)) % np.uint64(TOKENS)]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first nodes of all trees, two tokens deep, without the tokens. A node's number begins with its tree's."""
    for batch in batches:
        tokens = _tokens(batch.column("tokens"))
        for tree in range(TREES):
            seed = mix(np.array([tree + 77], np.uint64))[0]
            node = _path(seed, tokens, _picks(seed, 2)) >> _TREE_BITS | np.uint64(tree << 58)
            yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("k1")], ["node", "k1"])


def _like(n: np.ndarray, m: np.ndarray, equal: np.ndarray, least: int = LOW) -> np.ndarray:
    """Pairs of sets of sizes n and m that may be links by their equal tokens and sizes."""
    return (equal >= least) & (100 * np.minimum(n, m) >= 80 * np.maximum(n, m))


def _equal(columns: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Equal tokens of one class and each column's."""
    return (columns == one[:, None]).sum(0, dtype=np.uint8)


def _forest(n: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A node's heaviest spanning forest (ends, equal tokens), and the classes of trees that have further pairs.

    Prim's way: a class joins by the best pair it has with one that has joined.
    """
    m, columns = len(n), np.ascontiguousarray(tokens.T)
    best, parent = np.zeros(m, np.int16), np.zeros(m, np.int64)
    tree, pairs, i, k = np.zeros(m, np.int64), np.zeros(m, np.int64), 0, -1
    ends, weights = [], []
    for _ in range(m):
        i = int(best.argmax())
        if best[i] > 0:
            ends.append((parent[i], i))
            weights.append(best[i])
        else:  # nothing joins a tree; -1 marks those that have
            i = int(np.flatnonzero(best == 0)[0])
            k += 1
        tree[i], best[i] = k, -1
        equal = _equal(columns, tokens[i])
        like = _like(n, n[i], equal)
        pairs[i] = like.sum() - 1
        better = np.flatnonzero(like & (best >= 0) & (equal > best))
        best[better], parent[better] = equal[better], i
    size, found = np.bincount(tree), np.bincount(tree, pairs)
    more = found > 2 * (size - 1)
    ends = np.array(ends, np.int64).reshape(-1, 2)
    return ends[:, 0], ends[:, 1], np.array(weights, np.int64), np.flatnonzero(more[tree])


def _by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole nodes of rows in which a node's stand together, some at a time, and where each begins."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        node = held["node"].to_numpy()
        last = int(np.flatnonzero(node != node[-1])[-1]) + 1 if len(node) and node[0] != node[-1] else 0
        if last:
            yield held.slice(0, last), np.append(np.flatnonzero(np.append(True, node[1:last] != node[: last - 1])), last)
            held = held.slice(last)
    if held is not None and len(held):
        yield held, np.array([0, len(held)])


#: What a comparison tells: a link ``a, b, alike``, or (b null) a class ``a`` of a node to be looked at again.
_TOLD = "a bigint, b bigint, alike int, node bigint"


def _told(a: list, b: list, alike: list, left: list, node: list) -> pa.RecordBatch:
    a, b, alike, left, node = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (a, b, alike, left, node))
    nulls = np.append(np.zeros(len(a), bool), np.ones(len(left), bool))
    pad = np.zeros(len(left), np.int64)
    return pa.RecordBatch.from_pydict(
        {
            "a": pa.array(np.append(np.minimum(a, b), left), pa.int64()),
            "b": pa.array(np.append(np.maximum(a, b), pad), pa.int64(), mask=nulls),
            "alike": pa.array(np.append(alike, pad).astype(np.int32), pa.int32(), mask=nulls),
            "node": pa.array(np.append(np.zeros(len(a), np.int64), node), pa.int64(), mask=~nulls),
        }
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node, its forest and the classes of trees with further pairs."""
    for table, edges in _by_node(batches):
        node, k1, n = (table[c].to_numpy() for c in ("node", "k1", "n"))
        tokens = _tokens(table["tokens"].combine_chunks())
        two = edges[:-1][np.diff(edges) == 2]  # most nodes; all at once
        equal = (tokens[two] == tokens[two + 1]).sum(1)
        like = _like(n[two], n[two + 1], equal)
        a, b, alike, left, where = [k1[two[like]]], [k1[two[like] + 1]], [equal[like]], [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo > 2:
                i, j, weight, more = _forest(n[lo:hi], tokens[lo:hi])
                a.append(k1[lo + i])
                b.append(k1[lo + j])
                alike.append(weight)
                left.append(k1[lo + more])
                where.append(np.full(len(more), node[lo]))
        yield _told(a, b, alike, left, where)


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each node, all pairs between components that stand together in no node before it (``nodes`` has those
    of a class): singly where they are few, else the classes that have any."""
    for table, edges in _by_node(batches):
        node, k1, n = (table[c].to_numpy() for c in ("node", "k1", "n"))
        tokens, root = _tokens(table["tokens"].combine_chunks()), np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        nodes = table["nodes"].combine_chunks()
        begin, each = nodes.offsets.to_numpy(), nodes.value_lengths().to_numpy()
        before = np.full((len(k1), max(1, each.max())), np.iinfo(np.int64).max)
        before[np.repeat(np.arange(len(k1)), each), np.arange(each.sum()) - np.repeat(begin[:-1] - begin[0], each)] = nodes.values.to_numpy()[begin[0] : begin[-1]]
        before[before >= node[:, None]] = np.iinfo(np.int64).max
        a, b, left, where = [], [], [], []
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own, columns = root[lo:hi], np.ascontiguousarray(tokens[lo:hi].T)
            largest, found = np.bincount(own).argmax(), [np.zeros((0, 2), np.int64)]
            done = np.zeros(hi - lo, bool)
            for i in np.flatnonzero(own != largest).tolist():  # pairs of the largest with others are among these
                done[i] = True
                j = np.flatnonzero(_like(n[lo:hi], n[lo + i], _equal(columns, tokens[lo + i])) & (own != own[i]) & ~done)
                for other in before[lo + i][before[lo + i] < node[lo]]:
                    j = j[(before[lo + j] != other).all(1)]
                found.append(np.stack([np.full(len(j), i), j], 1))
            pairs = np.concatenate(found)
            if len(pairs) <= SINGLY * (hi - lo):
                a.append(k1[lo + pairs[:, 0]])
                b.append(k1[lo + pairs[:, 1]])
            else:
                more = np.unique(pairs)
                left.append(k1[lo + more])
                where.append(np.full(len(more), node[lo]))
        yield _told(a, b, [np.zeros(len(x), np.int64) for x in a], left, where)


def _branched(rows: pa.Table, pivots: pa.Table) -> pa.Table:
    """A part of a large node: each class's pivots with their equal tokens, and the children it goes on to.

    The node picks as many tokens at once as should bring its children to half of SMALL, by the pivots' own
    likeness. A link at the threshold keeps together on one path with ``0.8 ** deep``, so a class goes on twice as
    many paths as make up for that (seven links of eight stay); where most of the node is alike, on one, and the
    node's number is told, so that it is looked at again.
    """
    node, size = np.uint64(rows["node"][0].as_py() % (1 << 64)), rows["size"][0].as_py()
    k1, n, tokens = rows["k1"].to_numpy(), rows["n"].to_numpy(), _tokens(rows["tokens"].combine_chunks())
    order = np.argsort(pivots["p"].to_numpy())
    p, p_n = pivots["p"].to_numpy()[order], pivots["p_n"].to_numpy()[order]
    p_tokens = _tokens(pivots["p_tokens"].combine_chunks())[order]
    equal = np.stack([(tokens == x).sum(1) for x in p_tokens], 1)
    among = [(p_tokens[i] == p_tokens[j]).mean() for i in range(len(p)) for j in range(i)]
    likeness = min(0.99, max(0.05, float(np.mean(among)) if among else 0.5))
    deep = int(np.clip(np.ceil(np.log(2 * size / rows["small"][0].as_py()) / -np.log(likeness)), 1, TOKENS))
    paths = 1 if likeness > ONE_PATH else int(np.ceil(2 * 0.8**-deep))
    stays = (equal.max(1) < ALIKE) & ~np.isin(k1, p)
    at = np.flatnonzero(stays)
    seeds = mix(np.array([node ^ np.uint64(0xABCD + k) for k in range(paths)], np.uint64))
    tree = node >> np.uint64(58) << np.uint64(58)
    nodes = (np.stack([_path(x, tokens[at], _picks(x, deep)) for x in seeds], 1) >> _TREE_BITS | tree).view(np.int64)
    near = (equal >= NEAR) & (k1[:, None] != p)
    where, which = np.nonzero(near)
    lists = [np.append(0, np.cumsum(x)) for x in (near.sum(1), stays * paths)]
    ratio = 100 * np.minimum(n[where], p_n[which]) >= 80 * np.maximum(n[where], p_n[which])
    return pa.table(
        {
            "k1": rows["k1"],
            "n": rows["n"],
            "tokens": rows["tokens"],
            "pivots": pa.ListArray.from_arrays(pa.array(lists[0], pa.int32()), pa.array(p[which], pa.int64())),
            "alike": pa.ListArray.from_arrays(pa.array(lists[0], pa.int32()), pa.array(np.where(ratio, 1, -1) * equal[where, which], pa.int32())),
            "nodes": pa.ListArray.from_arrays(pa.array(lists[1], pa.int32()), pa.array(nodes.ravel(), pa.int64())),
            "wide": pa.array(np.full(len(k1), node).view(np.int64), mask=np.full(len(k1), paths > 1)),
        }
    )


def _counted(rows: DataFrame) -> DataFrame:
    """Rows of nodes that have more than one, with the count."""
    counts = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(counts, "node")


def _one_level(large: DataFrame, small: int) -> DataFrame:
    """:func:`_branched` of all large nodes, each dealt to parts of about ``small`` classes."""
    # The same classes are pivots in all trees, so that what they tell is mostly told once.
    bucket = F.pmod(F.xxhash64("k1"), F.lit(PIVOTS))
    own = F.struct(F.col("k1").alias("p"), F.col("n").alias("p_n"), F.col("tokens").alias("p_tokens"))
    parts = F.ceil(F.col("size") / small).cast("bigint")
    pivots = large.groupBy("node", bucket.alias("bucket")).agg(F.min_by(own, F.xxhash64("k1", F.lit(1))).alias("pivot"), F.first("size").alias("size"))
    pivots = pivots.select("node", "pivot.*", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"))
    dealt = large.withColumns({"part": F.pmod(F.xxhash64("k1", F.lit(2)), parts), "small": F.lit(small)})
    schema = "k1 bigint, n bigint, tokens binary, pivots array<bigint>, alike array<int>, nodes array<bigint>, wide bigint"
    return stored(dealt.groupBy("node", "part").cogroup(pivots.groupBy("node", "part")).applyInArrow(_branched, schema), "branched")


class Suggested(NamedTuple):
    links: DataFrame  # distinct a, b, alike
    open: DataFrame  # node, k1: classes of trees of which nodes have further pairs
    near: DataFrame | None  # distinct k1, p, alike: classes near pivots
    wide: DataFrame | None = None  # node, k1: large nodes that went on by one path


def suggested(classes: DataFrame, small: int = SMALL) -> Suggested:
    """What nodes of all trees tell of classes ``k1, n, tokens``."""
    first = _counted(classes.select("k1", "tokens").mapInArrow(_roots, "node bigint, k1 bigint"))
    at = stored(first.join(classes.select("k1", "n", "tokens"), "k1").select("node", "k1", "n", "tokens", "size"), "paths")
    levels, near, wide, done = [], [], [], [at]
    while True:
        levels.append(at.where(F.col("size") <= small).drop("size"))
        large = at.where(F.col("size") > small)
        if large.isEmpty():
            break
        branched = _one_level(large, small)
        pairs = F.explode(F.arrays_zip("pivots", "alike")).alias("x")
        near.append(branched.select("k1", pairs).select("k1", F.col("x.pivots").alias("p"), F.col("x.alike").alias("alike")))
        wide.append(branched.where("wide IS NOT NULL").select(F.col("wide").alias("node"), "k1"))
        at = stored(_counted(branched.select(F.explode("nodes").alias("node"), "k1", "n", "tokens")), "paths")
        done += [branched, at]
    told = stored(_union(levels).repartition("node").sortWithinPartitions("node").mapInArrow(_compared, _TOLD), "compared")
    links, around, below = told.where("b IS NOT NULL").select("a", "b", "alike"), None, None
    if near:
        around, below = stored(_union(near).distinct(), "near"), stored(_union(wide), "wide")
        best = around.where(F.col("alike") >= LOW).groupBy("k1").agg(F.max_by("p", F.struct("alike", "p")).alias("p"), F.max("alike").alias("alike"))
        links = links.union(best.select(F.least("k1", "p"), F.greatest("k1", "p"), "alike"))
    links = stored(links.groupBy("a", "b").agg(F.first("alike").alias("alike")), "suggested")
    dropped(*done)
    return Suggested(links, told.where("b IS NULL").select("node", F.col("a").alias("k1")), around, below)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out


def _is_link(a: pa.Scalar, b: pa.Scalar) -> bool:
    x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [_is_link(a, b) for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _of_hub(hub: pa.Table, others: pa.Table) -> pa.Table:
    """Links of a hub, whose set is in the only row of the one side, with a block of others."""
    keep = [_is_link(hub["set"][0], x) for x in others["set"]] if len(hub) else []
    kept = others.select(["hub", "k1"]).filter(pa.array(keep, pa.bool_()))
    a, b = kept["hub"].to_numpy(), kept["k1"].to_numpy()
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _full_sets(ends: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """``k1, set`` of the classes ``k1`` asked for; one text of each is found and read again."""
    spark = docs.sparkSession
    rows = ends.join(classes.select("k1", "row"), "k1")
    word, bit = F.pmod("row", F.lit(FILTER_WORDS)), F.expr("shiftleft(1L, cast(pmod(shiftright(row, 24), 64) as int))")
    bits = np.zeros(FILTER_WORDS, np.int64)
    packed = rows.groupBy(word.cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    bits[packed["word"].to_numpy()] = packed["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            row = batch.column("row").to_numpy()
            hit = bits[row % FILTER_WORDS] >> ((row >> 24) % 64) & 1
            batch = batch.filter(pa.array(hit == 1))
            for part in small_batches(iter([batch])):
                values, edges, k1, _ = _sets(part, width)
                raw = memoryview(np.ascontiguousarray(values)).cast("B")
                yield pa.RecordBatch.from_pydict({"k1": pa.array(k1), "set": pa.array([raw[8 * a : 8 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())})

    found = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(sets, "k1 bigint, set binary")
    return stored(found.join(ends, "k1", "left_semi").dropDuplicates(["k1"]), "sets")


def confirmed(links: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The links ``a, b`` whose full sets meet the threshold.

    A class of over HUB links is a hub. Its set isn't joined to each of them: it goes once to each block of about HUB others.
    """
    ends = links.select(F.col("a").alias("k1")).union(links.select("b"))
    found = _full_sets(ends.distinct(), docs, classes, width)
    hubs = stored(ends.groupBy("k1").agg(F.count("*").alias("links")).where(F.col("links") > HUB), "hubs")
    named = links.select("a", "b").join(hubs.toDF("a", "_a"), "a", "left").join(hubs.toDF("b", "_b"), "b", "left")
    few = named.where("_a IS NULL AND _b IS NULL").select("a", "b")
    pairs = few.join(found.toDF("a", "set_a"), "a").join(found.toDF("b", "set_b"), "b")
    out = pairs.mapInArrow(_confirmed, "a bigint, b bigint")
    if not hubs.isEmpty():
        first = F.coalesce("_a", F.lit(0)) >= F.coalesce("_b", F.lit(0))
        many = named.where("_a IS NOT NULL OR _b IS NOT NULL").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("k1"))
        blocks = hubs.select(F.col("k1").alias("hub"), F.ceil(F.col("links") / HUB).cast("bigint").alias("blocks"))
        others = many.join(blocks, "hub").select("hub", F.pmod(F.xxhash64("k1"), "blocks").alias("block"), "k1").join(found, "k1")
        each = blocks.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
        own = each.join(found.toDF("hub", "set"), "hub")
        out = out.union(own.groupBy("hub", "block").cogroup(others.groupBy("hub", "block")).applyInArrow(_of_hub, "a bigint, b bigint"))
    out = stored(out, "confirmed")
    dropped(found)
    return out


def _settled(table: pa.Table) -> pa.Table:
    """Links between different components of a block, or of two blocks, by the full sets.

    Shingles of many sets are counted by products of 0-1 matrices, those of few pair by pair; those of one
    set are in no intersection.
    """
    k1, root, block = table["k1"].to_numpy(), np.unique(table["root"].to_numpy(), return_inverse=True)[1], table["block"].to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]]
    m, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    counts = np.diff(np.append(starts, len(values)))
    both = np.zeros((m, m), np.float32)
    often = np.flatnonzero(counts > FEW)
    for k in range(0, len(often), 1024):
        own = often[k : k + 1024]
        x = np.zeros((m, len(own)), np.float32)
        at = np.repeat(starts[own] - (np.cumsum(counts[own]) - counts[own]), counts[own]) + np.arange(counts[own].sum())
        x[owner[at], np.repeat(np.arange(len(own)), counts[own])] = 1
        both += x @ x.T
    rank, n = np.arange(len(values)) - np.repeat(starts, counts), np.repeat(counts, counts)
    for step in range(1, FEW):
        at = np.flatnonzero((n <= FEW) & (rank >= step))
        if len(at):
            both += np.bincount(owner[at - step] * m + owner[at], minlength=m * m).reshape(m, m)
    both = both.astype(np.int64)
    hit = 100 * both >= 80 * (sizes[:, None] + sizes - both)
    hit &= (root[:, None] != root) & ((block[:, None] != block) | (block.min() == block.max()))
    i, j = np.nonzero(np.triu(hit, 1))
    _, one = np.unique(np.minimum(root[i], root[j]) * m + np.maximum(root[i], root[j]), return_index=True)
    return pa.table({"a": pa.array(k1[i[one]], pa.int64()), "b": pa.array(k1[j[one]], pa.int64())})


def _settle(rows: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """Confirmed links between components of each node of ``node, k1, root``: every pair is tried.

    A node is dealt to blocks of about BLOCK shingles and 1,024 classes, and each two blocks meet in a task.
    """
    sized = rows.join(classes.select("k1", "n"), "k1")
    of = sized.groupBy("node").agg(F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / 1024)).cast("bigint").alias("blocks"))
    placed = sized.join(of, "node").withColumn("block", F.pmod(F.xxhash64("k1"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other")
    dealt = placed.select("node", "k1", "root", "block", other).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    found = _full_sets(rows.select("k1").distinct(), docs, classes, width)
    out = stored(dealt.drop("other").join(found, "k1").groupBy("node", "x", "y").applyInArrow(_settled, "a bigint, b bigint"), "settled")
    dropped(found)
    return out


def _around(near: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A pivot and what left with it, and what is near the pivot and not joined to it: two sides ``p, k1``."""
    named = near.join(roots.toDF("k1", "root"), "k1", "left").join(roots.toDF("p", "p_root"), "p", "left")
    apart = F.coalesce("root", "k1") != F.coalesce("p_root", "p")
    others = stored(named.where(apart).select("p", "k1"), "beside")
    wanted = others.select("p").distinct()
    own = named.where((F.col("alike") >= ALIKE) & ~apart).select("p", "k1").join(wanted, "p", "left_semi")
    return own.union(wanted.select("p", F.col("p").alias("k1"))), others


def _two_sided(own: DataFrame, others: DataFrame) -> DataFrame:
    """``node, k1``: for each ``p`` its classes ``p, k1`` of the one side and of the other, so that each block of the
    one meets each of the other in a node."""
    both = own.withColumn("side", F.lit(0)).union(others.withColumn("side", F.lit(1)))
    counts = both.groupBy("p").agg(*[F.ceil(F.count_if(F.col("side") == k) / most).cast("bigint").alias(f"n{k}") for k, most in ((0, MANY), (1, 1024))])
    counts = counts.where("n0 > 0 AND n1 > 0")
    dealt = both.join(counts, "p").withColumn("block", F.pmod(F.xxhash64("k1"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))))
    meets = F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0")) - 1)).alias("other")
    dealt = dealt.select("p", "k1", "side", "block", meets)
    pair = [F.when(F.col("side") == k, F.col("block")).otherwise(F.col("other")) for k in (0, 1)]
    # These nodes come after those of all trees.
    return dealt.select(F.shiftrightunsigned(F.xxhash64("p", *pair), 6).bitwiseOR(F.lit(31 << 58)).alias("node"), "k1")


def _one_sided(rows: DataFrame) -> DataFrame:
    """``node, k1``: for each ``p`` its classes ``p, k1``, so that each two blocks meet in a node."""
    counts = rows.groupBy("p").agg(F.ceil(F.count("*") / 1024).cast("bigint").alias("blocks"))
    placed = rows.join(counts, "p").withColumn("block", F.pmod(F.xxhash64("k1"), "blocks"))
    dealt = placed.select("p", "k1", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    node = F.xxhash64("p", F.least("block", "other"), F.greatest("block", "other"), F.lit("one"))
    return dealt.select(F.shiftrightunsigned(node, 6).bitwiseOR(F.lit(31 << 58)).alias("node"), "k1")


def _outside(wide: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of large nodes that went on by one path: their largest components, wherever their classes stand, and what isn't
    in a node's largest, as two sides ``p, k1``; and the latter by node."""
    named = wide.join(roots.toDF("k1", "root"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    sizes = named.groupBy("node", "root").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("node").agg(F.max_by("root", F.struct("n", "root")).alias("p"))
    out = stored(named.join(largest, "node").where(F.col("root") != F.col("p")).select("node", "p", "k1"), "outside")
    others = stored(out.select("p", "k1").distinct(), "outside")
    wanted = others.select("p").distinct()
    # A component without a link has no root.
    own = roots.select(F.col("root").alias("p"), F.col("node").alias("k1")).join(wanted, "p", "left_semi").union(wanted.select("p", F.col("p").alias("k1")))
    return own, others, out.select(F.col("node").alias("p"), "k1")


def _again(found: Suggested, roots: DataFrame) -> DataFrame:
    """``node, k1``: what is looked at again, pair by pair."""
    if found.near is None:
        return found.open
    own, others = _around(found.near, roots)
    more, outside, within = _outside(found.wide, roots)
    rows = found.open
    if not others.isEmpty() or not outside.isEmpty():
        rows = rows.union(_two_sided(own.union(more).distinct(), others.union(outside).distinct()))
    return rows if within.isEmpty() else rows.union(_one_sided(within))


def _between(found: Suggested, roots: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame | None:
    """Confirmed links between components in nodes that have pairs beyond their forests."""
    rows = _again(found, roots)
    named = rows.distinct().join(roots.toDF("k1", "root"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    apart = named.groupBy("node").agg((F.min("root") != F.max("root")).alias("apart")).where("apart").select("node")
    again = stored(named.join(apart, "node", "left_semi"), "apart")
    if again.isEmpty():
        return None
    # Nodes of trees that a class is in are as many as its paths, at most.
    nodes = again.where(F.col("node") < TREES << 58).groupBy("k1").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    known = classes.select("k1", "n", "tokens").join(nodes, "k1", "left").withColumn("nodes", F.coalesce("nodes", F.array().cast("array<bigint>")))
    looked = again.join(known, "k1").select("node", "k1", "n", "tokens", "root", "nodes").repartition("node").sortWithinPartitions("node")
    told = stored(looked.mapInArrow(_crossing, _TOLD), "crossing")
    out = []
    single = stored(told.where("b IS NOT NULL").select("a", "b").distinct().join(found.links, ["a", "b"], "left_anti"), "singly")
    if not single.isEmpty():
        out.append(confirmed(single, docs, classes, width))
    many = told.where("b IS NULL").select("node", F.col("a").alias("k1"))
    if not many.isEmpty():
        many = many.join(roots.toDF("k1", "root"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
        out.append(_settle(many, docs, classes, width))
    return _union(out) if out else None


def near_duplicates(docs: DataFrame, width: int = 5, small: int = SMALL) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of each row of ``docs`` (``doc_id``, ``text``).

    Links join texts whose sets have a similarity of 0.8 or more; ``component_id`` is the
    smallest ``doc_id`` reachable by links. A null or empty text, or one without words, has
    an empty set and no links; its component is its own id. Of rows with one ``doc_id`` all
    are given back and ``kept`` alike; null ids take part, and give way to any other as a
    component's id. Other columns are ignored. An empty table gives an empty table. A very long
    text's set is held whole by a task, eight bytes a shingle.
    """
    out = _classed(docs, width, small)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, small: int = SMALL) -> DataFrame:
    """The rows of ``docs`` with one of each group of near-duplicates: that of the smallest id, null last.

    Rows without words all stay. All columns are kept, whatever their names. Of rows that repeat with id and
    text any one stays, whatever further columns hold.
    """
    out = stored(_classed(docs, width, small).where("n > 0"), "grouped")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    chosen = out.groupBy("root").agg(F.min(own)["row"].alias("chosen"))
    rows = out.join(chosen, "root").groupBy("row").agg(F.count("*").alias("n"), F.max(F.col("row") == F.col("chosen")).alias("stays"))
    rows = stored(rows.where(~F.col("stays") | (F.col("n") > 1)), "gone")

    def chosen_of(d: DataFrame) -> DataFrame:
        named = d.withColumn("_row", F.xxhash64("doc_id", "text"))
        left = named.join(rows.where(~F.col("stays")).select(F.col("row").alias("_row")), "_row", "left_anti")
        again = rows.where("stays").select(F.col("row").alias("_row"))
        if not again.isEmpty():  # rows that repeat with id and text
            repeated = left.join(again, "_row", "left_semi").dropDuplicates(["_row"])
            left = left.join(again, "_row", "left_anti").unionByName(repeated)
        return left

    return guarded(docs, chosen_of)


def _classed(docs: DataFrame, width: int, small: int) -> DataFrame:
    """``doc_id, row, n, root, component_id`` of each row."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    prints = stored(rows.mapInArrow(_prints(width), "doc_id bigint, row bigint, n bigint, k1 bigint, k2 bigint, tokens binary"), "prints")
    # A set is known by a 64-bit hash from here on; the second hash and the size tell sets apart that share it.
    classes = stored(prints.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.first("tokens").alias("tokens")), "classes")
    found = suggested(classes, small)
    ends = found.links.union(found.links.select("b", "a", "alike"))
    best = ends.groupBy(F.col("a").alias("u")).agg(F.max_by("b", F.struct("alike", "b")).alias("v"))
    sure = confirmed(best.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct(), docs, classes, width)
    roots = stored(components(sure), "roots")
    named = found.links.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left")
    rest = stored(named.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "rest")
    if not rest.isEmpty():
        roots = joined(roots, confirmed(rest, docs, classes, width))
    more = _between(found, roots, docs, classes, width)
    if more is not None:
        roots = joined(roots, more)
    dropped(found.links, rest)
    member = classes.select("k1", "k2", "n", "doc_id").join(roots.toDF("k1", "root"), "k1", "left").withColumn("root", F.coalesce("root", "k1"))
    least = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    names = member.join(least, "root").select("k1", "k2", "n", "root", "component_id")
    return prints.select("doc_id", "row", "n", "k1", "k2").join(names, ["k1", "k2", "n"], "left").select("doc_id", "row", "n", "root", "component_id")
