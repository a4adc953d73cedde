"""Streams give what the batch plan gives."""

from datetime import datetime, timedelta

from roadloom.operators.segments import split_walk
from roadloom.streaming import online

T0 = datetime(2024, 1, 8)
SCHEMA = "TrackId long, RowId long, DeviceToken string, PointDate timestamp_ntz, Latitude double, Longitude double, Speed double, TotalMeters double"


def points(spark, track):
    return spark.createDataFrame([(track, i, "d", T0 + timedelta(hours=track, seconds=i), 55.0, 37.0, float(i % 20), float(i)) for i in range(50)], SCHEMA)


def test_stream_equals_batch(spark, tmp_path):
    for t in (1, 2, 3):
        points(spark, t).coalesce(1).write.parquet(str(tmp_path / "in" / f"t={t}"))
    plan = lambda df: split_walk(df).select("TrackId", "RowId", "is_car")
    src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = online.score_stream(src, plan, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("TrackId", "RowId", "is_car").collect())
    want = sorted(tuple(r) for t in (1, 2, 3) for r in plan(points(spark, t)).collect())
    assert got == want


def test_last_trip_state(spark, tmp_path):
    for i, (t, h) in enumerate([(1, 5), (2, 9), (3, 7)]):
        spark.createDataFrame([("d", t, T0 + timedelta(hours=h))], "DeviceToken string, TrackId long, EndDate timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "h" / f"b={i}"))
    src = spark.readStream.schema("DeviceToken string, TrackId long, EndDate timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "h"))
    q = online.last_trip_per_device(src).writeStream.outputMode("update").format("memory").queryName("last_trip").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("last_trip").collect()
    assert max((r.end_us, r.TrackId) for r in rows)[1] == 2


def test_batch_sessions(spark):
    df = points(spark, 1).unionByName(points(spark, 9))
    assert sorted(r.n for r in online.sessions(df).collect()) == [50, 50]
    assert online.unique_points(df.unionByName(df), ["TrackId", "RowId"]).count() == 100
