"""Kernels against hand-made cases and brute force."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from roadloom.functions import kernels as k

points = st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=40).map(lambda x: np.array(x, float))


def test_simplify_cases():
    assert k.simplify(np.zeros((1, 2)), 1).tolist() == [0, 0]
    line = np.array([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0]], float)
    assert k.simplify(line, 1.0).tolist() == [0, 2, 3, 4]
    loop = np.array([[0, 0], [3, 4], [0, 0]], float)
    assert k.simplify(loop, 4.9).tolist() == [0, 1, 2]
    assert k.simplify(loop, 5.0).tolist() == [0, 2]


def plain_simplify(xy, eps):
    """A stretch at a time."""
    n = len(xy)
    keep, todo = {0, n - 1}, [(0, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        rel, way = xy[a + 1 : b] - xy[a], xy[b] - xy[a]
        span = np.sqrt(way[0] * way[0] + way[1] * way[1])
        d = np.abs(way[0] * rel[:, 1] - way[1] * rel[:, 0]) if span > 0 else rel[:, 0] * rel[:, 0] + rel[:, 1] * rel[:, 1]
        far = int(np.argmax(d))
        if (d[far] / span if span > 0 else np.sqrt(d[far])) > eps:
            keep.add(a + 1 + far)
            todo += [(a, a + 1 + far), (a + 1 + far, b)]
    return sorted(keep) if n > 1 else [0, 0]


def test_simplify_many_lines_at_once():
    rng = np.random.default_rng(8)
    lines = [np.round(np.cumsum(rng.normal(size=(n, 2)), axis=0), 1) for n in (1, 2, 300, 1, 3, 57, 2000, 2)]
    lines.append(np.zeros((40, 2)))
    starts = np.cumsum([0, *(len(x) for x in lines[:-1])])
    got = k.simplify_many(np.concatenate(lines), starts, 1.3).tolist()
    assert got == [int(s) + i for s, x in zip(starts, lines, strict=True) for i in plain_simplify(x, 1.3)]
    assert k.simplify_many(np.zeros((0, 2)), np.zeros(0, int), 1.0).tolist() == []


@given(points, st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_simplify_keeps_within_eps(xy, eps):
    at = k.simplify(xy, eps)
    assert at[0] == 0 and at[-1] == len(xy) - 1
    for a, b in zip(at, at[1:], strict=False):
        if b - a > 1:
            way = xy[b] - xy[a]
            span = np.hypot(*way)
            rel = xy[a + 1 : b] - xy[a]
            d = np.abs(way[0] * rel[:, 1] - way[1] * rel[:, 0]) / span if span else np.hypot(*rel.T)
            assert d.max() <= eps + 1e-9


@given(points, st.integers(1, 6), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_clusters_match_brute_force(xy, eps, least):
    got = k.cluster_planar(xy, eps, least)
    near = ((xy[:, None] - xy[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    want, label = np.full(len(xy), -1), 0
    for i in range(len(xy)):
        if core[i] and want[i] < 0:
            group = {i}
            while True:
                more = set(np.flatnonzero((near[sorted(group)].any(axis=0)) & core).tolist()) | group
                if more == group:
                    break
                group = more
            want[sorted(group)] = label
            label += 1
    for i in np.flatnonzero(~core):
        own = [want[j] for j in np.flatnonzero(near[i]) if core[j]]
        want[i] = min(own) if own else -1
    assert got.tolist() == want.tolist()


def test_low_pass_and_gravity():
    assert k.low_pass(np.array([1.0, 3.0, 3.0]), np.array([0, 0.5, 0.5])).tolist() == [1.0, 2.0, 2.5]
    n = 400
    tilt = np.radians(30)
    acc = np.tile([0.0, np.sin(tilt), np.cos(tilt)], (n, 1))
    up, spin = k.steady_up(acc, np.zeros((n, 3)), np.arange(n) * 0.1)
    assert abs(up[-1] - 1) < 1e-6 and np.allclose(spin, 0)


def test_spectrum_finds_sine():
    t = np.linspace(0, 10, 1000)
    f, a = k.spectrum(t, np.sin(2 * np.pi * t))
    assert abs(f[a.argmax()] - 1) < 0.01 and f.min() >= 0


def test_clusters_of_a_parked_phone():
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal(0, 5, (40_000, 2)), rng.normal(0, 5, (20_000, 2)) + [400, 0], [[1000.0, 0.0], [95.0, 0.0]]])
    got = k.cluster_planar(xy, 100.0, 3)
    assert set(got[:40_000]) == {0} and set(got[40_000:60_000]) == {1} and got[-2] == -1 and got[-1] == 0


def test_clusters_on_the_sphere():
    rng = np.random.default_rng(1)
    lat = np.concatenate([rng.normal(60, 0.01, 60), rng.normal(-89.99, 0.01, 40), [0.0, 0.0, 0.0]])
    lon = np.concatenate([rng.normal(180, 0.02, 60), rng.uniform(-180, 180, 40), [179.999, -179.999, 0.0]])
    r = 6_371_000.0
    a, b = np.radians(lat), np.radians(lon)
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a[:, None]) * np.cos(a) * np.sin((b[:, None] - b) / 2) ** 2
    near = 2 * r * np.arcsin(np.sqrt(np.minimum(1, h))) <= 1000
    at = k.sphere(lat, lon)
    assert (k.dense(at, k.chord(1000), 4) == (near.sum(axis=1) >= 4)).all()
    got = k.density_labels(at, k.chord(1000), 2)
    core = near.sum(axis=1) >= 2
    for i in range(len(lat)):
        for j in np.flatnonzero(near[i] & core):
            assert not core[i] or got[i] == got[j]
    assert got[-3] == got[-2] >= 0 and got[-1] == -1


def test_smoothing():
    y = k.smooth_centred(np.ones(300), 200)
    assert np.allclose(y, 1)
    assert np.isnan(k.smooth_centred(np.ones(5), 200)).all()
    assert k.hold(np.array([np.nan, 1, np.nan, 2])).tolist() == [1, 1, 1, 2]
