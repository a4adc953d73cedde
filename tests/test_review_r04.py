"""Cases of a review: places on borders, exact shares, constant values, halves in rounding."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from roadloom import queries
from roadloom.operators import geometry, learning, sensors
from roadloom.sources import sinks

T0 = datetime(2024, 1, 8)


def test_positions_of_constant_values(spark):
    """A stretch in which speed or acceleration is constant has no correlation; its screen direction is 0."""
    rows = [(1, i, T0 + timedelta(seconds=100 * i), 10.0, 1.0 * i, 40.0, 1.0) for i in range(9)] + [(2, i, T0 + timedelta(seconds=100 * i), 1.0 * i * i, 1.0 * i, 40.0, 1.0) for i in range(9)]
    p = spark.createDataFrame(rows, f"TrackId long, RowId long, PointDate timestamp_ntz, Speed double, {sensors.ACC[2]} double, smoothed_theta double, theta_amplitude double")
    assert {r.TrackId: r.screen_direction for r in sensors.positions(p).collect()} == {1: 0.0, 2: 0.5}
    flat = p.withColumn(sensors.ACC[2], F.lit(1.0))
    assert {r.TrackId: r.screen_direction for r in sensors.positions(flat).collect()} == {1: 0.0, 2: 0.0}


def test_borders_are_in_no_country(spark):
    square = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    lands = spark.createDataFrame([("A", [square(0.0, 4.0), square(1.0, 2.0)]), ("B", [[(10.0, 0.0), (12.0, 0.0), (11.0, 1.0)]])], "iso2 string, rings array<array<struct<x:double,y:double>>>")
    places = {1: (0.5, 0.5), 2: (0.0, 0.5), 3: (0.5, 0.0), 4: (4.0, 3.0), 5: (0.0, 0.0), 6: (1.0, 1.5), 7: (1.5, 1.5), 8: (1.5, 2.0), 9: (10.5, 0.5), 10: (11.0, 1.0), 11: (11.0, 0.5), 12: (11.0, 0.0)}
    p = spark.createDataFrame([(i, x, y) for i, (x, y) in places.items()], "RowId long, lon double, lat double")
    found = {(r.RowId, r.iso2) for r in geometry.country_of(p, lands, "lat", "lon", ["RowId"]).collect()}
    assert found == {(1, "A"), (6, "A"), (8, "A"), (11, "B")}


def test_shares_of_large_classes_are_exact(spark):
    """More rows of a class than a sketch tells apart; 7 of 10 is no double."""
    e = spark.range(250_000).withColumn("label", F.when(F.col("id") < 3, None).otherwise(F.col("id") % 7 == 0))
    train, test = (x.cache() for x in learning.stratified_split(e, "label", "id", 0.7))
    sizes = [{r.label: r["count"] for r in x.groupBy("label").count().collect()} for x in (train, test)]
    for k, n in e.groupBy("label").count().collect():
        assert sizes[0][k] == -(-7 * n // 10) and sizes[0][k] + sizes[1].get(k, 0) == n
    assert train.intersect(test).isEmpty()


def test_halves_are_rounded_as_by_sql(spark):
    values = [4.0453125, 7.949375, -7.949375, 12.5, 1e300, float("nan"), float("inf"), None]
    out = [r.x for r in queries.rounded(spark.createDataFrame([(v,) for v in values], "x double").coalesce(1), 6).collect()]
    assert out[:5] == [4.045312, 7.949375, -7.949375, 12.5, 1e300] and out[5] != out[5] and out[6:] == [float("inf"), None]


def test_seconds_are_not_broadcast(spark):
    """Few samples far apart make many seconds; these are never taken for a small table, and gaps stay as they were."""
    rows = [(t, 10 * t + i, T0 + timedelta(seconds=s), v) for t in range(3) for i, (s, v) in enumerate([(0, None), (40, 1.0), (40, 3.0), (100, None), (160, 8.0), (200, None)])]
    p = spark.createDataFrame(rows, "TrackId long, RowId long, PointDate timestamp_ntz, theta double")
    grid = sensors.resample_seconds(p, "theta")
    value = {(r.second - T0).seconds: r.value for r in grid.where("TrackId = 1").collect()}
    assert len(value) == 201 and grid.count() == 603
    assert [value[s] for s in (0, 39, 40, 41, 100, 160, 161, 200)] == [None, None, 2.0, 2.05, 5.0, 8.0, None, None]
    out = sensors.smooth_theta(p, 20, 6)
    plain = sensors.rolling_amplitude(sensors.smooth(grid, 20), "smooth", 6)
    want = {(r.TrackId, r.second): (r.smooth, r.amplitude) for r in plain.collect()}
    got = out.collect()
    assert len(got) == 18 and all((r.smoothed_theta, r.theta_amplitude) == want[r.TrackId, r.PointDate] for r in got) and got[0].theta_amplitude is not None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Broadcast" not in plan


def test_folders_of_small_trips_are_written_by_all_tasks(spark, tmp_path):
    """Adaptive execution would draw the small data into one task; each task names its files by its own number."""
    p = spark.range(400).select((F.col("id") % 40).alias("TrackId"), "id")
    sinks.write_by_trip(p, str(tmp_path / "trips"), "TrackId")
    files = list((tmp_path / "trips").glob("TrackId=*/part-*.parquet"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) == 4
    assert spark.read.parquet(str(tmp_path / "trips")).count() == 400
