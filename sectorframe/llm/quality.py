"""Quality of whole texts by compression: which of two dictionaries makes them smaller.

Zstandard dictionaries are built from good and from bad labelled texts. A text is compressed
with each, piece by piece, so that a piece's size tells of the dictionary and not of the pieces
before. The difference of the sizes over the text's bytes becomes a score by a logistic curve,
fitted on labelled texts that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, stored, text_column
from .labelled import fit_logistic, labelled_sample, logistic

PIECE = 1024
DICTIONARY = 64 << 10
LEVEL = 3
#: Labelled texts of each class that are learned from, at most. Of each text of the half that dictionaries are built
#: from, the driver gets SAMPLED pieces at most, from all over the text; of the other half three numbers.
PER_CLASS, SAMPLED = 6000, 4


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: np.ndarray


def pieces(text: bytes | memoryview) -> Iterator[bytes | memoryview]:
    return (text[k : k + PIECE] for k in range(0, len(text), PIECE))


def spread(text: bytes | memoryview) -> list[bytes]:
    """SAMPLED pieces of a text at even distances, its first and last among them; all of them if there are fewer."""
    n = -(-len(text) // PIECE)
    return [bytes(text[PIECE * k : PIECE * (k + 1)]) for k in np.unique(np.linspace(0, n - 1, SAMPLED).round().astype(int)).tolist()] if n else []


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of few pieces, which training refuses, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:] or b" "


def _compressor(data: bytes) -> zstandard.ZstdCompressor:
    kept = zstandard.ZstdCompressionDict(data)
    kept.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_checksum=False)


def measures(texts: list[bytes | memoryview], good: bytes, bad: bytes) -> np.ndarray:
    """Of each text: normalised size difference, log of its bytes, and their product."""
    a, b = _compressor(good), _compressor(bad)
    out = np.zeros((len(texts), 3))
    for k, text in enumerate(texts):
        if len(text):
            difference = sum(len(b.compress(p)) - len(a.compress(p)) for p in pieces(text))
            size = np.log(len(text))
            out[k] = difference / len(text), size / 10, difference / len(text) * size / 10
    return out


def _raw(texts: pa.Array) -> list[memoryview]:
    """Bytes of each text, not copied."""
    return [memoryview(t.as_buffer()) for t in texts]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches):
        found = [spread(t) for t in _raw(text_column(batch))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "y", "pieces"])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The two dictionaries and the curve, from a bounded sample of labelled texts of each class.

    Half of the sample builds the dictionaries, the other half, measured whole by Spark, the curve. With a class
    missing, all scores are the share of the labels that are 1 (one half without labels).
    """
    sample = stored(labelled_sample(docs, labels, "quality", per_class).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))), "quality-sample")
    n = {(r.y, r.half): r.n for r in sample.groupBy("y", "half").agg(F.count("*").alias("n")).collect()}
    all_, ones = sum(n.values()), sum(v for (y, _), v in n.items() if y == 1)
    if not 0 < ones < all_:
        p = np.clip((ones + 0.5) / (all_ + 1), 1e-6, 1 - 1e-6)
        return Model(b"", b"", np.array([0.0, 0.0, 0.0, np.log(p / (1 - p))]))
    # Of a very small sample all serves for both.
    learn, tune = (sample.where(F.col("half") == k) for k in (0, 1)) if len(n) == 4 else (sample, sample)
    rows = learn.mapInArrow(_sampled, "doc_id bigint, y int, pieces array<binary>").toPandas().sort_values("doc_id")
    good, bad = (dictionary([bytes(p) for own in rows["pieces"][rows["y"] == q] for p in own]) for q in (1, 0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            x = measures(_raw(text_column(batch)), good, bad)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), *(pa.array(x[:, k]) for k in range(3))], ["doc_id", "y", "a", "b", "c"])

    x = tune.mapInArrow(measured, "doc_id bigint, y int, a double, b double, c double").toPandas().sort_values("doc_id")
    return Model(good, bad, fit_logistic(x[["a", "b", "c"]].to_numpy(), x["y"].to_numpy(np.float64), ridge=1e-3))


def score(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"]) -> DataFrame:
    """The columns ``keep`` and ``score``, from 0 to 1, of each row of ``docs``.

    A null or empty text gets the score of no difference. Null ids, repeated rows and other
    columns are kept as they are.
    """
    good, bad, weights = model
    fields = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            x = measures(_raw(text_column(batch, "_text")), good, bad) if good else np.zeros((batch.num_rows, 3))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(logistic(x, weights))], [*keep, "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*fields.fields, StructField("score", DoubleType())])
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id``, ``text``); ``labels`` has
    ``doc_id`` and ``quality``.

    A null or empty text gets the score of no difference. Null ids count as not held out and are never labelled;
    repeated rows are all scored, alike; other columns are ignored. An empty table gives an empty one. Without
    labels of both kinds all scores are equal. A text of any length is compressed piece by piece.
    """
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
