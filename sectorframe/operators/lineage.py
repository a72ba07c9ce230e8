"""Cutting the lineage of tables that iterations build on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


#: Whether a write's shuffles are deleted with its end and not with the driver's next garbage collection.
_CLEANS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of what goes to a Python worker at once, beside which a task's buffers grow to several times as much.
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: For rows of megabytes: Parquet's writer looks at its size after each and not after a hundred, and a reader holds one group.
_LARGE = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1}


def written(df: DataFrame, large: bool = False) -> tuple[DataFrame, str]:
    """The table, written to the checkpoint folder and read back, and its path there; what its write shuffled is deleted.
    ``large``: its rows are of megabytes."""
    spark = df.sparkSession
    folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir names no folder")
    path, settings = f"{folder}/{uuid.uuid4().hex}", {_CLEANS: "true"} | ({_BATCH: str(8 << 20)} if large else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.select("*").write.options(**(_LARGE if large else {})).parquet(path)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """The table, written to the checkpoint folder and read back.

    Unlike ``checkpoint()``, nothing of the plan stays: that keeps the plan's size estimate, which joins multiply, so that
    after some dozens of them planning takes longer than the job. Raises where no checkpoint folder is set.
    """
    return written(df)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that :func:`written` wrote and that nothing will read again."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
