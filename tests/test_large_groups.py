"""One trip or device that holds most rows: spread over tasks, with the results of the plain kernels."""

from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadloom.functions import kernels
from roadloom.functions.geo import on_sphere
from roadloom.operators import density, scans, sensors
from roadloom.operators.components import components

T0 = datetime(2024, 1, 8)


def plain_labels(xy, eps, least):
    """All pairs."""
    near = ((xy[:, None] - xy[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label, n = np.full(len(xy), -1), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], n
            while todo:
                for j in np.flatnonzero(near[todo.pop()] & core & (label < 0)):
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.flatnonzero(~core):
        beside = label[near[i] & core]
        label[i] = beside.min() if len(beside) else -1
    return label


def shapes(rng, n):
    """A parked crowd, copies, a sparse line, two discs whose rims are just within and just beyond the radius, noise."""
    turn = rng.uniform(0, 2 * np.pi, n)
    disc = np.column_stack([np.cos(turn), np.sin(turn)]) * np.sqrt(rng.uniform(0, 1, n))[:, None]
    parts = [rng.normal(0, 3, (n, 2)), np.repeat(rng.uniform(300, 340, (5, 2)), n // 10, axis=0), np.column_stack([np.arange(30) * 9.0 - 800, np.zeros(30)])]
    parts += [disc * 40 + [600, 0], disc[::-1] * 40 + [689.95, 0], disc * 40 + [600, 400], disc[::-1] * 40 + [690.4, 400], rng.uniform(-900, 900, (40, 2))]
    xy = np.concatenate(parts)
    return xy[rng.permutation(len(xy))]


@pytest.mark.parametrize("levels", [6, 1])
def test_clusters_of_a_spread_group(spark, monkeypatch, levels):
    monkeypatch.setattr(density, "LEVELS", levels)
    rng = np.random.default_rng(3)
    groups = {1: shapes(rng, 160), 2: rng.uniform(0, 60, (30, 2)), 7: rng.normal(0, 20, (200, 2))}
    rows = [(k, i, float(x), float(y)) for k, xy in groups.items() for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "k long, i long, x double, y double").repartition(5)
    got = {(r.k, r.i): r.labels for r in density.labelled(df, "k", ["i"], {"x": F.col("x"), "y": F.col("y")}, 10.0, 4, large=100).collect()}
    assert len(got) == len(rows)
    for k, xy in groups.items():
        assert [got[k, i] for i in range(len(xy))] == plain_labels(xy, 10.0, 4).tolist(), k


def test_places_of_a_spread_device(spark):
    rng = np.random.default_rng(4)
    lat = np.concatenate([55 + rng.normal(0, 0.003, 150), 55.2 + rng.normal(0, 0.01, 60), rng.uniform(54, 56, 20)])
    lon = np.concatenate([37 + rng.normal(0, 0.003, 150), 37.2 + rng.normal(0, 0.01, 60), rng.uniform(36, 38, 20)])
    rows = [(d, i, float(a), float(o)) for d in (1, 2) for i, (a, o) in enumerate(zip(lat, lon, strict=True)) if d == 1 or i % 5 == 0]
    df = spark.createDataFrame([*rows, (1, 999, None, 37.0)], "d long, i long, lat double, lon double")
    out = density.labelled(df, "d", ["i"], on_sphere("lat", "lon"), kernels.chord(1000.0), 4, True, "label", large=100).collect()
    for d in (1, 2):
        mine = sorted((r.i, r.label, r.lat, r.lon) for r in out if r.d == d and r.i != 999)
        at = kernels.sphere(*(np.array([r[k] for r in mine]) for k in (2, 3)))
        dense = kernels.dense(at, kernels.chord(1000.0), 4, strict=True)
        want = np.full(len(at), -1)
        want[dense] = kernels.density_labels(at[dense], kernels.chord(1000.0), 4)
        assert [r[1] for r in mine] == want.tolist() and want.max() > 0
    assert [r.label for r in out if r.i == 999] == [-1]


def test_kernels_of_many_groups():
    rng = np.random.default_rng(5)
    parts = [rng.uniform(-50, 50, (n, 2)) + 1e6 * n for n in (1, 40, 3, 200, 90)]
    group = np.repeat(np.arange(5), [len(p) for p in parts])
    got = kernels.density_labels(np.concatenate(parts), 9.0, 3, group)
    assert got.tolist() == [x for p in parts for x in kernels.density_labels(p, 9.0, 3).tolist()]
    assert kernels.dense(np.concatenate(parts), 9.0, 3, True, group).tolist() == [x for p in parts for x in kernels.dense(p, 9.0, 3, True).tolist()]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_filter_of_a_long_trip(spark):
    rng = np.random.default_rng(6)
    sizes = {1: 3000, 2: 1, 3: 40, 9: 700}
    rows = []
    for k, n in sizes.items():
        at = np.cumsum(rng.integers(0, 3, n))  # some steps of no time
        rows += [(k, i, T0 + timedelta(seconds=float(a) / 4), float(v)) for i, (a, v) in enumerate(zip(at, rng.normal(size=n), strict=True))]
    df = spark.createDataFrame(rows, "TrackId long, RowId long, PointDate timestamp_ntz, v double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        got = {(r.TrackId, r.RowId): r.smooth for r in sensors.low_pass(df, "v").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for k, n in sizes.items():
        mine = [r for r in rows if r[0] == k]
        dt = np.diff([r[2].timestamp() for r in mine], prepend=mine[0][2].timestamp())
        want = kernels.low_pass(np.array([r[3] for r in mine]), np.where(dt > 0, dt / (0.5 + dt), 0.0))
        assert np.allclose([got[k, i] for i in range(n)], want, rtol=0, atol=1e-12)
    assert sensors.low_pass(df.where("false"), "v").count() == 0


def test_missing_values_stay_in_their_trip(spark):
    rows = [(k, i, T0 + timedelta(seconds=i), None if (k, i) == (1, 2) else 1.0) for k in (1, 2) for i in range(5)]
    got = {(r.TrackId, r.RowId): r.smooth for r in sensors.low_pass(spark.createDataFrame(rows, "TrackId long, RowId long, PointDate timestamp_ntz, v double"), "v").collect()}
    assert [np.isnan(got[1, i]) for i in range(5)] == [False, False, True, True, True] and [got[2, i] for i in range(5)] == [1.0] * 5


def test_composed_steps():
    rng = np.random.default_rng(7)
    a, b = rng.uniform(0, 1, 500), rng.normal(size=500)
    a[[0, 100, 101, 350]] = 0.0
    x, want = 0.0, []
    for s, t in zip(a, b, strict=True):
        x = s * x + t
        want.append(x)
    assert np.allclose(scans.composed(a, b)[1], want)
    assert pa.array(scans.composed(a[:1], b[:1])[1]).to_pylist() == [b[0]]
