"""The streaming frequency table over a file stream."""

from pyspark.sql import functions as F

from tessera.streaming.counts import windowed_crosstab, windowed_frequency


def test_windowed_frequency(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a"), ("2024-01-01 00:00:50", "a"), ("2024-01-01 00:01:10", "b"), ("2024-01-01 01:00:00", "z")]
    spark.createDataFrame(rows, "t string, k string").select(F.col("t").cast("timestamp").alias("t"), "k").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))
    query = windowed_frequency(stream, "t", ["k"], "1 minute", "5 minutes").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.k, r.Counts) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1), ("z", 1)]


def test_windowed_crosstab(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a", 1), ("2024-01-01 00:00:50", "a", 2), ("2024-01-01 00:00:55", "a", 3), ("2024-01-01 00:01:10", "b", 1)]
    spark.createDataFrame(rows, "t string, k string, v int").select(F.col("t").cast("timestamp").alias("t"), "k", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("t timestamp, k string, v int").parquet(str(tmp_path / "in"))
    query = windowed_crosstab(stream, "t", "k", "v", [1, 2], "1 minute", "5 minutes").writeStream.format("memory").queryName("crosstab").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.k, r["1"], r["2"], r.Total) for r in spark.table("crosstab").collect()) == [("a", 1, 1, 3), ("b", 1, 0, 1)]
