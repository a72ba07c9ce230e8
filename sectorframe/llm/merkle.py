"""A Merkle manifest of a table: a root over all documents, and each one's witness.

Every source's leaves, by id, are appended to a tree of its own in which three neighbours
become one. A subtree that is open (its run of three isn't whole) holds a partial witness: the
siblings seen so far. Each sibling that completes later extends it. What a subtree's witness
says holds for all leaves below, so that it is written down once and handed on when a block ends.

Blocks of ``3 ** DEPTH`` leaves begin at multiples of that, so they are whole subtrees, grown in
tasks of their own. Their roots are appended to the tree above like further leaves, and so on up;
the sources' roots are appended to the last tree. A leaf's witness is that of its place in the
block, then those of the block and of the source.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import numbered, stored

#: Neighbours that become one, and levels of a block: 6,561 nodes.
ARITY, DEPTH = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(text: Column | None = None) -> Column:
    """A document's leaf as 32 bytes: the digest of its fields, each with its length; ``-`` stands for null."""

    def told(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    parts = [told(text if text is not None and c == "text" else F.col(c)) for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def joined(nodes: list[bytes]) -> bytes:
    """The digest of neighbours, whose digests go in as hex text."""
    return sha256(b"".join(nodes).hex().encode()).digest()


class Frontier:
    """A tree to which nodes are appended: its subtrees by level, and the partial witness of each."""

    def __init__(self) -> None:
        self.nodes: list[list[bytes]] = [[]]
        self.seen: list[list[list[bytes]]] = [[]]

    def append(self, node: bytes, level: int = 0) -> None:
        if level == len(self.nodes):
            self.nodes.append([])
            self.seen.append([])
        nodes, seen = self.nodes[level], self.seen[level]
        begin = len(nodes) - len(nodes) % ARITY
        for witness in seen[begin:]:
            witness.append(node)
        seen.append(nodes[begin:])
        nodes.append(node)
        if len(nodes) - begin == ARITY:
            self.append(joined(nodes[begin:]), level + 1)

    def closed(self, levels: int | None = None) -> tuple[bytes, list[bytes]]:
        """The root, and each leaf's witness up to it; the last run of each level may be short.

        ``levels``: how many there are above the leaves; by default as many as lead to one node.
        """
        level = 0
        while level < levels if levels is not None else len(self.nodes[level]) > 1:
            if rest := len(self.nodes[level]) % ARITY:
                self.append(joined(self.nodes[level][-rest:]), level + 1)
            level += 1
        above = [b""]
        for seen in reversed(self.seen[:level]):
            above = [b"".join(own) + above[k // ARITY] for k, own in enumerate(seen)]
        return self.nodes[level][0], above


def folded(node: bytes, rank: int, total: int, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to; ``rank`` and ``total`` tell how long each level's run is."""
    at = 0
    while total > 1:
        place = rank % ARITY
        others = min(ARITY, total - rank + place) - 1
        own = [witness[at + 32 * k : at + 32 * k + 32] for k in range(others)]
        node = joined([*own[:place], node, *own[place:]])
        at += 32 * others
        rank, total = rank // ARITY, -(-total // ARITY)
    return node


def _blocks(size: int):
    """Grows each block of rows in which a block's stand together in order; adds witnesses within it, and its root."""
    levels = next(k for k in range(64) if ARITY**k == size)

    def grown(rows: pa.Table, edges: list[int]) -> Iterator[pa.RecordBatch]:
        nodes, totals, witnesses, roots = rows["node"].to_pylist(), rows["total"].to_numpy(), [], []
        for at, end in zip(edges[:-1], edges[1:], strict=True):
            tree = Frontier()
            for node in nodes[at:end]:
                tree.append(node)
            root, own = tree.closed(levels if totals[at] > size else None)
            witnesses += own
            roots += [root] * (end - at)
        out = rows.drop_columns(["block"]).append_column("witness", pa.array(witnesses, pa.binary())).append_column("block_root", pa.array(roots, pa.binary()))
        yield from out.to_batches(max_chunksize=1 << 14)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            block = held["block"].to_numpy()
            ends = ((block[1:] != block[:-1]).nonzero()[0] + 1).tolist()
            if ends:
                yield from grown(held.slice(0, ends[-1]), [0, *ends])
                held = held.slice(ends[-1])
        if held is not None and len(held):
            yield from grown(held, [0, len(held)])

    return run


def _grown(nodes: DataFrame, size: int) -> DataFrame:
    """Nodes ``begin, rank, total, node`` with ``witness, block_root``; further columns are kept."""
    block = F.col("begin") + F.col("rank") - F.col("rank") % size
    rows = nodes.withColumn("block", block).repartition("block").sortWithinPartitions("block", "rank")
    schema = T.StructType([*nodes.schema.fields, T.StructField("witness", T.BinaryType()), T.StructField("block_root", T.BinaryType())])
    return stored(rows.mapInArrow(_blocks(size), schema), "grown")


def _heads(grown: DataFrame, size: int) -> DataFrame:
    """One row for a block, as a node of the tree above."""
    up = F.expr(f"(total + {size - 1}) div {size}")
    return grown.where(F.col("rank") % size == 0).select("begin", F.expr(f"rank div {size}").alias("rank"), up.alias("total"), F.col("block_root").alias("node"))


def _trees(nodes: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Witnesses of nodes ``begin, rank, total, node`` within their blocks, and of their blocks: ``begin, block,
    above, tree_root``, up to the root of their tree."""
    grown = _grown(nodes, size)
    heads = _heads(grown, size).select("begin", F.col("rank").alias("block"), "total", F.col("node").alias("root"))
    blocks = heads.where("total = 1").select("begin", "block", F.lit(b"").alias("above"), F.col("root").alias("tree_root"))
    more = stored(heads.where("total > 1").select("begin", F.col("block").alias("rank"), "total", F.col("root").alias("node")), "heads")
    if not more.isEmpty():
        witnesses, higher = _trees(more, size)
        own = witnesses.withColumn("up", F.expr(f"rank div {size}")).join(higher.withColumnRenamed("block", "up"), ["begin", "up"])
        blocks = blocks.union(own.select("begin", F.col("rank").alias("block"), F.concat("witness", "above"), "tree_root"))
    return grown, blocks


def _proved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        proofs, roots = [], []
        names = ("node", "rank", "total", "witness", "source_rank", "sources", "source_witness")
        for node, rank, total, witness, of, sources, last in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
            proofs.append(sha256((witness + last).hex().encode()).hexdigest())
            roots.append(folded(folded(node, rank, total, witness), of, sources, last).hex())
        told = {"doc_id": batch.column("doc_id"), "leaf": batch.column("leaf"), "subroot": batch.column("subroot"), "root": batch.column("root"), "proof_sha256": pa.array(proofs), "folded_root": pa.array(roots)}
        yield pa.RecordBatch.from_pydict(told)


def manifest(docs: DataFrame, tampered: Column | None = None, depth: int = DEPTH) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row of ``docs`` (``doc_id, source,
    lang, n_chars, text``; others are ignored, whatever their names).

    ``subroot`` is the root of the row's source, ``root`` that of all; ``proof_sha256`` is the digest of the row's
    witness. ``folded_root`` is recomputed from the witness and the row's leaf, taken from the text ``tampered`` where
    that isn't null; ``verified`` tells whether it is the root.

    Null fields have a leaf of their own kind; a null source is a source, and comes first. Rows of a source go by id
    (null first), those of one id by leaf, and equal rows in any order: they have equal leaves, and the witnesses of
    their places. A source of one row has that row's leaf as its root. An empty table has no rows. Texts are hashed
    whole, where they are read; only digests move.
    """
    size = ARITY**depth
    changed = F.when(tampered.isNotNull(), leaf(tampered)) if tampered is not None else F.lit(None).cast("binary")
    own = docs.select("doc_id", "source", leaf().alias("node"), changed.alias("changed"), F.monotonically_increasing_id().alias("row"))
    rows = numbered(stored(own, "leaves"), ["source"], ["doc_id", "node", "row"]).drop("row", "source")
    grown, blocks = _trees(rows, size)
    blocks = stored(blocks, "blocks")
    tops = blocks.where("block = 0").select(F.col("begin").alias("source"), F.col("tree_root").alias("node"))
    trees, higher = _trees(numbered(tops, [], ["source"]), size)
    last = trees.withColumn("block", F.expr(f"rank div {size}")).join(higher, ["begin", "block"])
    last = last.select(F.col("source").alias("begin"), F.col("rank").alias("source_rank"), F.col("total").alias("sources"), F.concat("witness", "above").alias("source_witness"), F.col("tree_root").alias("root"))
    told = blocks.join(last, "begin").withColumnRenamed("tree_root", "subroot")
    # Rows meet their block, so that a source of any size is no single key.
    placed = grown.drop("block_root").withColumn("block", F.expr(f"rank div {size}")).join(told, ["begin", "block"])
    ready = placed.select(
        "doc_id", F.lower(F.hex("node")).alias("leaf"), F.coalesce("changed", "node").alias("node"), "rank", "total", F.concat("witness", "above").alias("witness"),
        "source_rank", "sources", "source_witness", F.lower(F.hex("subroot")).alias("subroot"), F.lower(F.hex("root")).alias("root"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = ready.mapInArrow(_proved, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_line_ends() -> Column:
    """The text without its line ends where 2 divides the id's crc32; else (and for a null id) null."""
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(chosen, F.translate("text", "\n", ""))
