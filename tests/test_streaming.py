from pathlib import Path

from pyspark.sql import functions as F

from sphaera.streaming.occupancy import energy_of, running_occupancy, windowed_occupancy

SF = Path("/root/testdata/sf0.001")


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(str(SF / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "value")
    for k, part in enumerate(batch.randomSplit([0.5, 0.5], 3)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"p={k}"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in" / "*"))
    q = running_occupancy(stream, 0.0, 100.0).writeStream.outputMode("complete").format("memory").queryName("occ").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["bin"]: r["occupancy"] for r in spark.table("occ").collect()}
    assert got == {r["bin"]: r["occupancy"] for r in running_occupancy(batch, 0.0, 100.0).collect()} and sum(got.values()) == batch.count()
    assert energy_of(spark.table("occ"), 0.59).agg(F.min("energy")).first()[0] == 0.0


def test_windows(spark, tmp_path):
    batch = spark.read.parquet(str(SF / "events.parquet")).withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "value")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = windowed_occupancy(stream, 0.0, 100.0, 10, "1 day").writeStream.outputMode("update").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("win").agg(F.sum("occupancy")).first()[0] == batch.count()
