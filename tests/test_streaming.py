"""The stream cleans as the batch does when each trigger brings later rows."""

from pyspark.sql import functions as F

from wakeline.operators import reports as R
from wakeline.streaming import tracks


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, i * 600_000_000, (50.0 if i % 7 == 3 else 0.0) + i * 0.01, 1.0) for i in range(40)]
    rows += [("b", 100 + i, (i // 2) * 600_000_000, 0.0, 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "mmsi string, pos long, t_us long, lon double, lat double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = tracks.clean_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("cleaned").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r.pos, r.rejected) for r in d.select("pos", "rejected").collect())
    assert key(spark.table("cleaned")) == key(R.clean(df))
    assert spark.table("cleaned").filter(F.col("rejected").isNotNull()).count() > 10


def test_a_later_trigger_does_not_set_a_vessel_back(spark, tmp_path):
    """A row that comes later but is earlier in time is rejected, and the next one is tested against the latest accepted."""
    schema = "mmsi string, pos long, t_us long, lon double, lat double"
    h = 3_600_000_000
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracks.clean_stream(stream).writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    for rows in ([("v", 1, 10 * h, 0.0, 0.0)], [("v", 2, 9 * h, 40.0, 0.0)], [("v", 3, 11 * h, 0.5, 0.0), ("v", 4, 12 * h, 40.0, 0.0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
    q.stop()
    assert {r.pos: r.rejected for r in spark.table("late_rows").collect()} == {1: None, 2: "out_of_order", 3: None, 4: "impossible_speed"}
