"""What lies beside trips: one pass with all places sent to the tasks gives what joins of grid cells give, without pairs in a join."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions.kernels import Places
from roadloom.operators import beside, geometry
from roadloom.operators.segments import split_walk
from roadloom.session import materialised

T0 = datetime(2024, 1, 8)


@pytest.fixture(scope="module")
def odd(spark):
    """Trips with a missing place, a missing speed, an upright step, a repeated place, one point, no side; stops that share a place or a name."""
    rng = np.random.default_rng(7)
    rows = []
    for t, n in enumerate([40, 1, 7, 300, 2, 25]):
        for i in range(n):
            lon, lat = 37 + round(rng.uniform(0, 0.004), 4), 55 + round(rng.uniform(0, 0.004), 4)
            rows.append([t, len(rows), T0 + timedelta(seconds=10 * i), lat, lon, round(float(rng.uniform(0, 40)), 2), i * 10.0, t % 2])
    for k, c, v in ((5, 3, None), (9, 5, None), (12, 4, rows[11][4]), (20, 3, rows[19][3]), (20, 4, rows[19][4])):
        rows[k][c] = v
    points = spark.createDataFrame([tuple(r) for r in rows], "TrackId long, RowId long, PointDate timestamp_ntz, Latitude double, Longitude double, Speed double, TotalMeters double, labels int")
    stops = [(f"s{i % 90}", 37 + i * 31 % 43 * 0.0001, 55 + i * 17 % 50 * 0.0001) for i in range(100)] + [("s1", 37.0031, 55.0017), ("twin", 37.0031, 55.0017), ("far", -120.0, -40.0), ("none", None, 55.0)]
    sides = spark.createDataFrame([(0, True), (2, False), (3, True), (4, False), (5, None)], "TrackId long, left boolean")
    return materialised(points), spark.createDataFrame(stops, "name string, lon double, lat double"), sides


def both(monkeypatch, make):
    """Rows by the pass and by the joins."""
    out = []
    for most in (beside.MOST, 0):
        monkeypatch.setattr(beside, "MOST", most)
        df = make()
        cols = sorted(df.columns)
        out.append(sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect()), key=repr))
    return out


def test_stops_beside(spark, odd, monkeypatch):
    points, stops, sides = odd
    whole = points.where("Latitude is not null")
    for make in (lambda: geometry.right_stops(points, stops), lambda: geometry.right_stops(whole, stops, nearest=True), lambda: geometry.bus_stops(points, stops, sides)):
        one, other = both(monkeypatch, make)
        assert one == other and len(one) > 50
    for make in (lambda: geometry.right_stop_speeds(whole, stops), lambda: geometry.bus_stop_features(split_walk(whole), stops, sides)):
        one, other = both(monkeypatch, make)
        assert one == other and len(one) == 6


def test_speeds_beside(spark, odd, monkeypatch):
    points, _, _ = odd
    one, other = both(monkeypatch, lambda: geometry.speed_profile(points.where("Latitude is not null"), points))
    assert one == other and sum("other" in r for r in one) > 500
    full = points.where("Latitude is not null and Speed is not null")
    one, other = both(monkeypatch, lambda: geometry.speed_curves(full, full.union(full)))
    assert len(one) == len(other) > 1000
    at, cols = np.array(one, float), sorted(["TrackId", "dist", "Speed"])
    assert np.allclose(at, np.array(other, float), atol=1e-4) and len(set(at[:, cols.index("TrackId")])) == 5


def test_no_pairs_in_a_join(spark, odd):
    """Points of others meet a trip's line by their distinct places, and stops meet trips in the pass."""
    points, stops, sides = odd
    for df in (geometry.speed_profile(points, points), geometry.bus_stops(points, stops, sides), geometry.right_stop_speeds(points, stops), geometry.speed_curves(points, points)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in plan and "cx" not in plan


def test_places_near_segments():
    rng = np.random.default_rng(1)
    x, y = rng.uniform(-5, 5, (2, 400))
    x[3] = np.nan
    ax, ay, bx, by = rng.uniform(-7, 7, (4, 60))
    bx[:5], by[5:10], ax[10] = ax[:5], ay[5:10], np.nan
    places = Places(x, y, 0.7)
    met = [(s, places.at[p]) for s, p in places.near(ax, ay, bx, by, 0.4, 1000)]
    pairs = set(zip(np.concatenate([s for s, _ in met]).tolist(), np.concatenate([p for _, p in met]).tolist(), strict=True))
    dx, dy = bx - ax, by - ay
    u = np.clip(((x[None] - ax[:, None]) * dx[:, None] + (y[None] - ay[:, None]) * dy[:, None]) / (dx**2 + dy**2)[:, None], 0, 1)
    gap = np.hypot(ax[:, None] + u * dx[:, None] - x[None], ay[:, None] + u * dy[:, None] - y[None])
    assert {(int(s), int(p)) for s, p in np.argwhere(gap <= 0.4)} <= pairs and len(pairs) < 60 * 400 / 3
    assert sum(len(s) for s, _ in met) == len(pairs)
    assert not list(Places(np.zeros(0), np.zeros(0), 1.0).near(ax, ay, bx, by, 1.0))
