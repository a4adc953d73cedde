"""Operators on small hand-made trips, degenerate inputs among them."""

import zipfile
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom import schema
from roadloom.functions import geo as gx
from roadloom.functions.stats import density_histogram
from roadloom.operators import features as ft
from roadloom.operators import geometry, history, learning, places, rules, segments, sensors
from roadloom.operators.grouped import map_groups
from roadloom.operators.prep import deduplicate
from roadloom.sources import sinks, trips

T0 = datetime(2024, 1, 8)
SCHEMA = "TrackId long, RowId long, DeviceToken string, PointDate timestamp_ntz, Latitude double, Longitude double, Speed double, TotalMeters double"


def trip(spark, speeds, step=1, track=1, device="d", start=T0, lat=55.0):
    rows, total = [], 0.0
    for i, v in enumerate(speeds):
        total += v / 3.6 * step if v else 0
        rows.append((track, i, device, start + timedelta(seconds=i * step), lat + i * 1e-5, 37.0, v, total))
    return spark.createDataFrame(rows, SCHEMA)


def test_walk_split_cases(spark):
    def parts(speeds):
        r = segments.split_walk(trip(spark, speeds)).orderBy("RowId").select("is_car", "is_walk").collect()
        return [i for i, x in enumerate(r) if x.is_car], [i for i, x in enumerate(r) if x.is_walk]

    assert parts([20.0, 20.0, 5.0, 5.0]) == ([0, 1, 2], [2, 3])
    assert parts([5.0, 5.0]) == ([0, 1], [1])
    assert parts([20.0, 20.0]) == ([0, 1], [1])
    assert parts([5.0, 20.0]) == ([0, 1], [1])
    assert parts([7.0]) == ([0], [0])


def test_stops_and_moves(spark):
    speeds = [20.0] * 10 + [0.0] * 20 + [20.0] * 10 + [0.0] * 4 + [20.0] * 3
    p = segments.intervals(segments.split_walk(trip(spark, speeds)))
    found = p.where("stop_s is not null or move_m is not null").orderBy("RowId").select("RowId", "stop_s", "move_m").collect()
    assert [(r.RowId, r.stop_s) for r in found if r.stop_s] == [(30, 20.0)]
    assert [r.RowId for r in found if r.move_m] == [10, 40]
    row = ft.move_rows(p).groupBy("TrackId").agg(*ft.stop_aggregates(), *ft.move_aggregates()).first()
    assert row["nstops"] == 1 and row["st_t(10,25)"] == pytest.approx(1 / 15)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0, x) for x in (0.0, 5.0, 10.0, 10.1, -1.0, None)] + [(1, 99.0)], "k int, x double")
    out = {r.k: r for r in df.groupBy("k").agg(*density_histogram(F.col("x"), [0, 5, 10], "h")).collect()}
    assert out[0]["h(0,5)"] == pytest.approx(1 / 15) and out[0]["h(5,10)"] == pytest.approx(2 / 15)
    assert out[1]["h(0,5)"] == 0 and out[1]["h(5,10)"] == 0


def test_dedupe_is_idempotent(spark):
    p = trip(spark, [1.0, 2.0, 3.0]).withColumn("Latitude", F.lit(1.0)).unionByName(trip(spark, [4.0], track=2))
    once = deduplicate(p)
    assert sorted((r.TrackId, r.RowId) for r in once.collect()) == [(1, 2), (2, 0)]
    assert deduplicate(once).count() == 2


def test_interpolation(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "TrackId long, RowId long, h double")
    assert [r.h for r in ft.interpolate(df, "h").orderBy("RowId").collect()] == [None, 2, 4, 6, 8, 8]


def test_rich_without_speeding(spark):
    p = trip(spark, [10.0, 10.0]).withColumns({"SpeedLimit": F.lit(50.0), "Height": F.lit(None).cast("double"), "FromSource": F.lit(True), "Urban": F.lit(None).cast("boolean")})
    r = ft.rich_features(p).first()
    assert (r.rel_overspeed_max, r.rel_overspeed_mean, r.rel_overspeed_median, r.rel_overspeed_std) == (1, 1, 1, 0)
    assert (r.rel_from_device, r.rel_urban, r.height_max, r.weekday, r.hour) == (1, 0, 0, 0, 0)


def test_longest_run_ignores_open_end(spark):
    p = trip(spark, [5.0, 5.0, 0.0, 5.0, 5.0, 5.0])
    assert segments.longest_run(p, F.col("Speed") > 1, ["RowId"]).first().longest_run == 2


def test_asof_keeps_ties_and_skips_later(spark):
    h = spark.createDataFrame([("a", 1, T0, T0 + timedelta(hours=1)), ("a", 2, T0, T0 + timedelta(hours=1)), ("a", 3, T0 + timedelta(hours=1), T0 + timedelta(hours=2)), ("b", 4, T0, T0)], "DeviceToken string, TrackId long, StartDate timestamp_ntz, EndDate timestamp_ntz")
    got = sorted((r.TrackId, r.prev_id) for r in history.latest_before(h, h).collect())
    assert got == [(3, 1), (3, 2), (4, 4)]


def test_distance_from_last_single_trip(spark):
    assert history.distance_from_last(trip(spark, [1.0, 2.0])).first().dist_from_last_track == 0


@pytest.mark.parametrize(("taxi", "bike", "has", "want"), [(1, False, True, ("Taxi", "")), (-1, True, True, ("Bicycle", "")), (0, False, True, ("Bus", "")), (0, False, False, ("OriginalDriver", "")), (1, False, False, (None, "track is empty"))])
def test_decisions(spark, taxi, bike, has, want):
    label, error = rules.decide(F.lit(taxi), F.lit(bike), F.lit(has), F.lit("Bus"))
    assert tuple(spark.range(1).select(label, error).first()) == want


@pytest.mark.parametrize(("v", "p", "km", "rail", "want"), [(20.0, 0.9, 9.0, 0.9, "Other"), (60.0, 0.9, 9.0, 0.9, "Train"), (60.0, 0.4, 9.0, 0.1, "Bus"), (60.0, 0.9, 2.0, 0.9, "OriginalDriver"), (60.0, None, 9.0, None, "OriginalDriver")])
def test_transport(spark, v, p, km, rail, want):
    df = spark.createDataFrame([(v, p, km, rail)], "v double, p double, km double, r double")
    assert df.select(rules.transport(F.col("v"), F.col("p"), F.col("km"), F.col("r"))).first()[0] == want


def test_gate(spark):
    df = spark.createDataFrame([("Bus", True, 1), ("Bus", False, 6), ("Bicycle", False, 6), ("Bus", None, 2), (None, False, 6)], "l string, a boolean, c int")
    assert [r[0] for r in df.select(rules.gate(F.col("l"), F.col("a"), F.col("c"))).collect()] == ["Bus", "Bus", "OriginalDriver", "OriginalDriver", None]


def airport_case(spark, first_end, second_start, hours, airport=(55.0, 37.0), **flags):
    def leg(track, start, a, b):
        rows = [(track, i, "d", start + timedelta(minutes=i), a[0] + (b[0] - a[0]) * i / 59 + i * 1e-7, a[1] + (b[1] - a[1]) * i / 59, 50.0, 0.0) for i in range(60)]
        return spark.createDataFrame(rows, SCHEMA)

    p = leg(1, T0, (55.3, 37.3), first_end).union(leg(2, T0 + timedelta(hours=hours), second_start, (second_start[0] + 0.3, second_start[1])))
    air = spark.createDataFrame([airport], "latitude double, longitude double")
    return {r.TrackId: r.taxi for r in rules.airport_taxi(p, air, **flags).collect()}


def test_airport_taxi_far_away(spark):
    at, far = (55.0, 37.0), (44.0, 20.0)
    got = airport_case(spark, at, far, 10, old=True)
    assert got[1] == 1
    assert airport_case(spark, at, at, 10, old=True)[1] == 0
    assert airport_case(spark, at, at, 80, fix_time_sign=True)[1] == 1
    assert airport_case(spark, (54.0, 37.0), (54.0, 37.0), 80)[1] == 0


def test_bicycle(spark):
    def case(top=20.0, shake=1.5, n=400):
        p = trip(spark, [min(top, 15.0 + (i % 10)) for i in range(n)])
        return rules.bicycle(p.withColumns({c: F.lit(shake) for c in sensors.GYRO})).first().bicycle

    assert case()
    assert not case(top=9.0) and not case(shake=0.1) and not case(n=200)
    assert not rules.bicycle(trip(spark, [15.0])).first().bicycle


def test_corridor_sides(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 0.01, 0.0, True), (2, 0.0, 0.0, 0.01, 0.0, False)], "TrackId long, ax double, ay double, bx double, by double, left boolean")
    stops = spark.createDataFrame([("l", 0.005, 0.0002), ("r", 0.005, -0.0002), ("cap", 0.0101, 0.0), ("far", 0.005, 0.01), ("on", 0.005, 0.0)], "name string, lon double, lat double")
    got = sorted((r.TrackId, r.name) for r in geometry.stops_along(seg, stops).collect())
    assert got == [(1, "l"), (1, "on"), (2, "on"), (2, "r")]


def test_coverage_merges_overlaps(spark):
    line = [(37.0 + i * 0.001, 55.0) for i in range(11)]
    v = spark.createDataFrame([(1, 0, i, x, y) for i, (x, y) in enumerate(line)], "TrackId long, labels int, seq int, Longitude double, Latitude double")
    way = lambda i, kind, a, b: (i, kind, [(a, 55.0001), (b, 55.0001)])
    ways = spark.createDataFrame([way(1, "rail", 37.0, 37.005), way(2, "rail", 37.003, 37.006), way(3, "bus", 37.008, 37.02), way(4, "tram", 38.0, 38.1)], "way_id long, way_type string, line array<struct<x:double,y:double>>")
    lengths = geometry.coverage(v, ways)
    row = geometry.way_features(lengths).first()
    assert row.rail_frequency == pytest.approx(0.6, abs=0.01) and row.bus_frac == pytest.approx(0.2, abs=0.01)
    assert row.rail_uncovered_len == pytest.approx(0.4 * 0.638, abs=0.02)


def test_near_part_matches_sampling(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(map(float, rng.uniform(-10, 10, 8))) for _ in range(200)]
    rows += [(0.0, 1.0, 5.0, 1.0, 0.0, 0.0, 5.0, 0.0), (0.0, 9.0, 5.0, 9.0, 0.0, 0.0, 5.0, 0.0), (2.0, 1.0, 2.0, 1.0, 0.0, 0.0, 5.0, 0.0), (2.0, 8.0, 2.0, 8.0, 0.0, 0.0, 5.0, 0.0), (2.0, -5.0, 2.0, 5.0, 0.0, 0.0, 5.0, 0.0)]
    names = ["px", "py", "qx", "qy", "ax", "ay", "bx", "by"]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, " + ", ".join(f"{n} double" for n in names))
    got = {r.i: r for r in gx.near_part(df, 3.0).collect()}
    t = np.linspace(0, 1, 2001)
    for i, (px, py, qx, qy, ax, ay, bx, by) in enumerate(rows):
        x, y, w = px + t * (qx - px), py + t * (qy - py), np.array([bx - ax, by - ay])
        u = np.clip(((x - ax) * w[0] + (y - ay) * w[1]) / (w @ w), 0, 1)
        near = t[np.hypot(x - ax - u * w[0], y - ay - u * w[1]) <= 3]
        if len(near):
            assert abs(got[i].lo - near[0]) < 1e-3 and abs(got[i].hi - near[-1]) < 1e-3, i
        else:
            assert i not in got or got[i].hi - got[i].lo < 1e-3, i


def test_places(spark):
    rows = [("d", T0 + timedelta(days=i % 5, hours=20), 55.0 + i * 1e-5, 37.0) for i in range(8)] + [("d", T0 + timedelta(days=i % 5, hours=9), 55.1 + i * 1e-5, 37.0) for i in range(6)]
    rows += [("d", T0 + timedelta(days=5 + i % 2), 55.2 + i * 1e-5, 37.0) for i in range(5)] + [("d", T0, 56.0, 37.0), ("e", T0, 55.0, 37.0)]
    ends = spark.createDataFrame(rows, "DeviceToken string, PointDate timestamp_ntz, Latitude double, Longitude double")
    got = {(r.DeviceToken, round(r.Latitude, 1)): r.place for r in places.places(ends).collect()}
    assert got == {("d", 55.0): "home", ("d", 55.1): "work", ("d", 55.2): "holy"}


def test_sensor_positions(spark):
    p = trip(spark, [30.0 + (i % 7) for i in range(1500)])
    p = p.withColumns({"AccelerationXOriginal": F.lit(0.1), "AccelerationYOriginal": F.lit(0.5), "AccelerationZOriginal": F.lit(0.8) + (F.col("RowId") % 7) * 1e-3, **{c: F.lit(0.01) for c in sensors.GYRO}})
    smooth = sensors.smooth_theta(sensors.orientation(p))
    assert sensors.positions(smooth).count() == 1
    best = sensors.longest_position(smooth).first()
    assert best.time_delta == 1498 and abs(best.screen_direction) == 0.5
    z = sensors.vertical_features(p).first()
    assert z.z_f2 == pytest.approx(0.95, abs=0.05) and z.z_f1 == pytest.approx(0, abs=1e-3)
    assert sensors.vertical_features(trip(spark, [1.0] * 5).withColumns({c: F.lit(1.0) for c in sensors.ACC + sensors.GYRO})).first().z_f0 == 0


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Id,DeviceToken,Distance,StartDate\n1,ABC,1.5,2024-01-02 03:04:05\nNA,,x,NA\n")
    df = trips.read_csv(spark, str(tmp_path / "a.csv"), "Id int, DeviceToken string, Distance double, StartDate timestamp_ntz, Missing string")
    assert [tuple(r) for r in df.collect()] == [(1, "ABC", 1.5, datetime(2024, 1, 2, 3, 4, 5), None), (None, None, None, None, None)]
    (tmp_path / "b.csv").write_text("t;X\n1,5;2,25\n")
    assert trips.read_csv(spark, str(tmp_path / "b.csv"), "t double, X double", sep=";", decimal=",").first()[1] == 2.25
    sinks.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    sinks.write_by_trip(trip(spark, [1.0]).unionByName(trip(spark, [1.0], track=2)), str(tmp_path / "by"), "TrackId")
    assert spark.read.parquet(str(tmp_path / "by")).select("TrackId").distinct().count() == 2


def test_zip_archives_read_as_csv(spark, tmp_path):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("a.csv", f"Id,DeviceToken,OverSpeedMileage\n{k},\"A,B\",0.7\nNA,,\n")
    df = trips.read_zip(spark, str(tmp_path / "*.zip"), "Id int, DeviceToken string, OverSpeedMileage double, Missing string")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted([(0, "A,B", 0.7, None), (1, "A,B", 0.7, None), (None, None, None, None), (None, None, None, None)], key=repr)
    with zipfile.ZipFile(tmp_path / "2.zip", "w") as z:
        z.writestr("a.csv", "Other\n1\n")
    with pytest.raises(ValueError, match="different columns"):
        trips.read_zip(spark, str(tmp_path / "*.zip"), "Id int")


def test_mileage_keeps_its_fraction(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Id,OverSpeedMileage,MidOverSpeedMileage,HighOverSpeedMileage\n1,0.7,1.5,2\n")
    r = trips.read_csv(spark, str(tmp_path / "t.csv"), schema.TRACKS).first()
    assert (r.OverSpeedMileage, r.MidOverSpeedMileage, r.HighOverSpeedMileage) == (0.7, 1.5, 2.0)


def test_balanced_matches_a_sort(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "abc"[int(rng.integers(0, 3))], int(rng.integers(0, 40))) for i in range(3000)] + [(9000 + i, "d", i % 7) for i in range(150)] + [(9999, "a", None)]
    df = spark.createDataFrame(rows, "id long, c string, v long")
    got = {r.id for r in history.balanced(df, "c", ["v", "id"]).collect()}
    want = set()
    for c in "abcd":
        mine = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        want |= {r[0] for r in mine[:150]}
    assert got == want and history.balanced(df.limit(0), "c", ["v"]).count() == 0


def test_end_counts_match_brute_force(spark):
    rng = np.random.default_rng(5)
    m = 8.9883063456985468e-06
    at = np.concatenate([rng.normal(0, 150 * m, (60, 2)), rng.normal(0, 50_000 * m, (60, 2)), rng.normal(3, 1, (10, 2)), [[0.0, 0.0]] * 3]) + [37, 55]
    p = spark.createDataFrame([(i, i, "d", T0, float(y), float(x), 1.0, 1.0) for i, (x, y) in enumerate(at)], SCHEMA)
    got = {r.TrackId: r for r in history.end_counts(p).collect()}
    gap = np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1])
    for r in history.END_RADII:
        want = ((gap < r * m).sum(axis=1) - 1) / len(at)
        assert np.allclose([got[i][f"rel_end_count_{r}"] for i in range(len(at))], want)


def test_names():
    assert sorted(["v(10,15)", "v(5,10)", "a(-23,-20)"], key=trips.natural_key) == ["a(-23,-20)", "v(5,10)", "v(10,15)"]
    files = ["/x/10_T.csv", "/x/2_T.csv", "/x/2_R.csv", "/x/2_I.csv"]
    assert trips.trip_files(files, ("T", "R", "I")) == [("/x/2_T.csv", "/x/2_R.csv", "/x/2_I.csv")]


def test_models(spark, tmp_path):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.rand(1) * 0.2).alias("x"), F.rand(2).alias("y"), (F.floor(F.col("id") / 2) % 4).cast("int").alias("fold"))
    model = learning.booster(df, drop=("id", "fold"), rounds=5)
    scored = learning.score(df, model)
    assert learning.auc(scored, "label", "proba").first().auc == 1.0
    assert learning.importances(model)[0][0] == "x"
    assert learning.select_important(df, model).columns == ["x", "label"]
    _, scores, sets = learning.cross_validate(df, {"maxDepth": [2]}, drop=("id",), folds=4, fold_col="fold")
    assert scores[0] > 0.95 and sets[0] == {"maxDepth": 2}
    assert learning.forest(df, drop=("id", "fold"), trees=5).transform(df).count() == 200
    learning.save_model(model, str(tmp_path / "model"))
    assert learning.score(df, learning.load_model(str(tmp_path / "model"))).select("id", "proba").exceptAll(scored.select("id", "proba")).count() == 0
    assert [s for s, a in learning.learning_curve(df.drop("fold"), "id", [0.5, 1.0], trees=5) if a > 0.9] == [0.5, 1.0]
    train, test = learning.stratified_split(df, "label", "id", 0.8)
    assert train.count() == 160 and test.count() == 40
    assert learning.auc(df.where("label = 1"), "label", "x").first().auc == 0


def test_irrelevant_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "weekday int, speed_max int, height_min int")
    assert learning.drop_irrelevant(df).columns == ["speed_max"]


def test_groups_go_on_over_batches(spark):
    sizes = {1: 7000, 2: 1, 3: 2500, None: 5}
    rows = [(k, i, float(i)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k int, i int, v double").repartition(3)

    def kernel(rows, starts):
        ends = np.append(starts[1:], rows.num_rows)
        v = rows.column(1).to_numpy()
        assert all((np.diff(v[a:b]) == 1).all() for a, b in zip(starts, ends, strict=True))
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(starts)), pa.array(ends - starts)], names=["k", "n"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = {r.k: r.n for r in map_groups(df, ["k"], ["i"], ["v"], "k int, n bigint", kernel).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sizes
    assert map_groups(df.where("false"), ["k"], ["i"], ["v"], "k int, n bigint", kernel).count() == 0


def test_coverage_arithmetic_is_written_once(spark):
    v = spark.createDataFrame([], "TrackId long, labels int, seq int, Longitude double, Latitude double")
    ways = spark.createDataFrame([], "way_id long, way_type string, line array<struct<x:double,y:double>>")
    plan = geometry.coverage(v, ways)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000


def test_speed_curve_of_degree_ten(spark):
    rng = np.random.default_rng(9)
    profiles = {1: np.sort(rng.uniform(0, 900, 80)), 2: np.sort(rng.uniform(0, 400, 11)), 3: np.arange(10) * 50.0, 4: np.arange(30) * 0.5}
    rows = [(k, float(x), float(30 + 10 * np.sin(x / 90) + rng.normal())) for k, xs in profiles.items() for x in xs]
    df = spark.createDataFrame(rows, "TrackId long, dist double, Speed double").repartition(3)
    out = geometry.speed_curve(df).collect()
    assert {r.TrackId for r in out} == {1, 2}  # too few places, and too short
    for k in (1, 2):
        x, y = (np.array([r[i] for r in rows if r[0] == k]) for i in (1, 2))
        got = sorted((r.dist, r.Speed) for r in out if r.TrackId == k)
        want = np.polynomial.Legendre.fit(x, y, 10)  # another basis, the same least squares
        assert len(got) == int(x.max() / 25) and np.allclose([s for _, s in got], want([d for d, _ in got]), atol=1e-5)
        assert got[0][0] == x.min() and got[-1][0] == x.max()
