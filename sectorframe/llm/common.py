"""What the operators share: tables kept in the cluster's shared folder, and rows by Arrow batch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Bytes of a record batch that Spark gives to Python, about, while a table is made by :func:`stored`.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one named by ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine serves a local master only; a cluster raises.
    """
    if not (own := spark.conf.get("sectorframe.scratch", None)):
        if found := spark.conf.get("spark.checkpoint.dir", None):
            own = f"{found.rstrip('/')}/sectorframe-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
        elif spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="spark-")
        else:
            raise ValueError("spark.checkpoint.dir names no folder that all machines of the cluster share")
        spark.conf.set("sectorframe.scratch", own)
    return own


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write a table in the shared folder and read it back, which cuts its lineage.

    The write goes through Spark's commit protocol, so lost executors cost a retry only.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`stored`, when nothing reads them again."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, name)


def clear(spark: SparkSession) -> None:
    """Delete all tables that the operators keep in the shared folder; results that weren't read yet are lost."""
    _delete(spark, shared_dir(spark))
    spark.conf.unset("sectorframe.scratch")


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``begin``, ``rank`` (from 0) and ``total``: each row's place in its group by an order that ends in
    a column without ties, and the group's size. ``begin`` is the number of rows in groups before, so it tells groups apart.

    Rows are dealt by range and sorted as they are written, so that no task orders more than a range, however large a
    group is; what is summed in one task is one count for each of the write's tasks. Null values come first.
    """
    keys = [*by, *order]
    sorted_ = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    own = stored(sorted_, "numbered").withColumn("_part", F.shiftright("_at", 33))  # the upper bits tell the task that wrote the row
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = own.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    if not by:
        total = own.agg(F.count("*").alias("total"))
        return own.join(parts, "_part").crossJoin(F.broadcast(total)).select(*rows.columns, F.lit(0).cast("bigint").alias("begin"), place.alias("rank"), "total")  # one row
    names = {f"_k{k}": F.col(c) for k, c in enumerate(by)}
    pieces = own.groupBy("_part", *[c.alias(k) for k, c in names.items()]).agg(F.count("*").alias("_rows"), F.min("_at").alias("_at")).join(parts, "_part")
    groups = pieces.groupBy(*names).agg(F.min(place).alias("begin"), F.sum("_rows").alias("total"))
    # A part's rows meet their group by part, so that a group of any size is no single key.
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"g.{k}")) for k in names]
    told = pieces.alias("p").join(groups.alias("g"), reduce(and_, same)).select(F.col("_part").alias("_p"), *[F.col(f"p.{k}").alias(k) for k in names], "_before", "begin", "total")
    here = [F.col("_part") == F.col("_p"), *[c.eqNullSafe(F.col(k)) for k, c in names.items()]]
    return own.join(told, reduce(and_, here)).select(*rows.columns, "begin", (place - F.col("begin")).alias("rank"), "total")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def guarded(docs: DataFrame, run) -> DataFrame:
    """``run`` on documents whose further columns have names that can't clash; they get theirs back after.

    ``run`` returns all columns it is given, in any order, and may add others, which are dropped.
    """
    own = {"doc_id", "text", "lang", "source"}
    names = [n if n in own else f"_extra_{k}" for k, n in enumerate(docs.columns)]
    return run(docs.toDF(*names)).select(*names).toDF(*docs.columns)


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A batch's texts as strings with 32-bit offsets; null texts count as empty."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(name).cast(pa.string()), "")


def small_batches(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text (or one row)."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            before = int(sizes[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
