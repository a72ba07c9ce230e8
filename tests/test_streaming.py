from pyspark.sql import functions as F

from sectorframe.operators import aggregates, joins
from sectorframe.streaming import running


def _play(spark, query, name, mode="complete"):
    stream = query.writeStream.outputMode(mode).format("memory").queryName(name).start()
    stream.processAllAvailable()
    stream.stop()
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "cells")
    cells = spark.range(400).select((F.col("id") % 20).alias("i"), F.floor(F.col("id") / 20).alias("j"), (F.col("id") % 3).cast("int").alias("sector"), (F.col("id") % 7).cast("double").alias("v"))
    cells.repartition(5).write.parquet(path)
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.sector: (r.n_cells, round(r.norm, 9)) for r in _play(spark, running.running_norm(stream), "norms").collect()}
    assert {s: n for s, (_, n) in got.items()} == {r.sector: round(r.norm, 9) for r in aggregates.norm(cells, ["sector"]).collect()}
    traces = {r.sector: r.trace for r in _play(spark, running.running_trace(stream), "traces").collect()}
    assert traces == {r.sector: r.trace for r in aggregates.trace(cells, ["sector"]).collect()}
    table = cells.select(F.col("i").alias("k"), "j", "v").where("k < 3")
    product = {(r.i, r.k): r.v for r in _play(spark, running.running_contract(stream, table, ["j"], ["i", "k"]), "products").collect()}
    assert product == {(r.i, r.k): r.v for r in joins.contract(cells, table, ["j"], ["i", "k"]).collect()}


def test_windows_leave_out_late_rows(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:02:00", "a"), ("2024-01-01 00:12:00", "b")], "t string, s string").withColumn("t", F.to_timestamp("t"))
    rows.coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    got = _play(spark, running.windowed_counts(stream, "t", "s", "10 minutes", "1 minute"), "windows", "append")
    assert [(r.s, r.n) for r in got.collect()] == [("a", 2)]
