"""From raw documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last
return the columns of documents; the mixing stage repeats a row for each copy. All take null ids, texts,
sources and languages, empty and very long texts, repeated rows and further columns of any name; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sectorframe.llm.common import documents, guarded, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more. A null or empty text has the score of texts whose sizes don't
    differ, whatever that is; long texts are scored whole, piece by piece; repeated rows stay or go together."""
    from sectorframe.llm.quality import fit, score

    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return guarded(docs, lambda d: score(d, model, d.columns).where(F.col("score") >= 0.3))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the declared ``lang`` gives way to the one found. Null and empty texts,
    and those of under three bytes, have none and go; long texts count whole; of equal shares the first language
    by name is taken."""
    from sectorframe.llm.language import identify, train

    model = train(docs)
    return guarded(docs, lambda d: identify(d, model, d.columns, F.col("source")).where("known").withColumn("lang", F.col("language")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, similarity 0.8 or more; that of the smallest id,
    null last. Texts without words all stay; of rows that repeat with id and text one stays."""
    from sectorframe.llm.near_dup import one_of_each

    return guarded(docs, lambda d: one_of_each(d, width=5))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is one of its own; texts without words
    are due copies like others; rows that repeat share their copies evenly."""
    from sectorframe.llm.mixing import mix

    return guarded(docs, mix)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences of 2048 tokens. A null or empty text is its end id;
    each row is a document of its own; a long text is cut into full sequences and one rest."""
    import public_tokenizers

    from sectorframe.llm.packing import pack

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=1, keep_ids=False)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: SQL can express none of the stages but mixing's targets; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
