"""Small numeric kernels for one trip's points; Spark deals out the trips."""

from __future__ import annotations

import math

import numpy as np


def simplify(xy: np.ndarray, eps: float) -> np.ndarray:
    """Indexes that stay of one line, see ``simplify_many``."""
    return simplify_many(xy, np.zeros(min(1, len(xy)), np.int64), eps)


def simplify_many(xy: np.ndarray, starts: np.ndarray, eps: float) -> np.ndarray:
    """Indexes that stay of lines that begin at ``starts``: a stretch is split at its farthest point while that is farther than eps.

    Farthest from the straight line through the stretch's ends, or from the end itself where both
    coincide; the first one at a tie. Both ends of a line always stay, a single point twice. All
    stretches of all lines are split together, level by level.
    """
    n = len(xy)
    x, y = (np.ascontiguousarray(xy[:, k], float) for k in (0, 1)) if n else (np.zeros(0), np.zeros(0))
    ends = np.append(starts[1:], n)[: len(starts)] - 1
    stays = np.zeros(n, np.int64)
    np.add.at(stays, starts, 1)
    np.add.at(stays, ends, 1)
    a, b = starts, ends
    while True:
        open_now = b - a >= 2
        a, b = a[open_now], b[open_now]
        if not len(a):
            return np.repeat(np.arange(n), stays)
        size = b - a - 1
        begin = np.cumsum(size) - size
        part = np.repeat(np.arange(len(a)), size)
        at = np.arange(len(part)) - begin[part] + a[part] + 1
        rx, ry = x[at] - x[a][part], y[at] - y[a][part]
        wx, wy = x[b] - x[a], y[b] - y[a]
        span = np.sqrt(wx * wx + wy * wy)
        # areas, or squares: in the order of the distances
        d = np.where(span[part] > 0, np.abs(wx[part] * ry - wy[part] * rx), rx * rx + ry * ry)
        d[np.isnan(d)] = -1.0
        top = np.maximum.reduceat(d, begin)
        hit = np.flatnonzero(d == top[part])
        cut = at[hit[np.unique(part[hit], return_index=True)[1]]]
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(span > 0, top / span, np.sqrt(np.maximum(top, 0.0))) > eps
        cut = cut[far]
        stays[cut] = 1
        a, b = np.concatenate([a[far], cut]), np.concatenate([cut, b[far]])


class Grid:
    """Points in cells so small that all points of a cell are within eps of each other.

    Only points in cells of few members are ever compared one by one, each with the points of the
    cells around; two full cells are compared in blocks until a pair is found. So the work follows the
    number of points, however many lie in one place. group: numbers from 0, ascending; points of two
    groups never meet.
    """

    def __init__(self, points: np.ndarray, eps: float, group: np.ndarray | None = None):
        n, d = points.shape
        self.eps = eps
        cells = np.floor(points / (eps / np.sqrt(d) * (1 - 1e-9))).astype(np.int64)
        group = np.zeros(n, np.int64) if group is None else group
        begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        low = np.minimum.reduceat(cells, begin) - 2
        cells -= np.repeat(low, np.diff(np.append(begin, n)), axis=0)
        spans = [int(x) + 3 for x in cells.max(axis=0)]
        steps = np.array([math.prod(spans[:k]) for k in range(d)])
        key = cells @ steps + group * math.prod(spans)
        self.order = np.argsort(key, kind="stable")
        self.points = points[self.order]
        self.keys, self.begin, self.count = np.unique(key[self.order], return_index=True, return_counts=True)
        self.cell = np.repeat(np.arange(len(self.keys)), self.count)
        axes = np.stack(np.meshgrid(*[np.arange(-2, 3)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        pairs = []
        for move in (axes @ steps).tolist():
            if move > 0:
                at = np.minimum(np.searchsorted(self.keys, self.keys + move), len(self.keys) - 1)
                hit = np.flatnonzero(self.keys[at] == self.keys + move)
                pairs.append(np.column_stack([hit, at[hit]]))
        self.pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)

    def within(self, i: np.ndarray, j: np.ndarray, strict: bool = False) -> np.ndarray:
        d2 = ((self.points[i] - self.points[j]) ** 2).sum(axis=1)
        return d2 < self.eps**2 if strict else d2 <= self.eps**2

    def compared(self, a: np.ndarray, b: np.ndarray, at_once: int = 1 << 20):
        """All pairs of points of the cells a[k] and b[k], so many at a time."""
        for k, at in expanded(self.count[a] * self.count[b], at_once):
            yield self.begin[a[k]] + at // self.count[b[k]], self.begin[b[k]] + at % self.count[b[k]]

    def around(self, few: np.ndarray):
        """Pairs of a cell of ``few`` and a cell around it or itself."""
        both = np.concatenate([self.pairs, self.pairs[:, ::-1]])
        both = both[few[both[:, 0]]]
        own = np.flatnonzero(few)
        return np.concatenate([both[:, 0], own]), np.concatenate([both[:, 1], own])


class Places:
    """Places sorted by grid cell, to be met by segments.

    x, y: those with both coordinates, by cell; at: their positions in what was given.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, size: float):
        self.size = size
        self.at = np.flatnonzero(np.isfinite(x) & np.isfinite(y))
        cells = [np.floor(v[self.at] / size).astype(np.int64) for v in (x, y)]
        self.low = [int(c.min()) if len(c) else 0 for c in cells]
        self.span = [int(c.max()) - low + 1 if len(c) else 0 for c, low in zip(cells, self.low, strict=True)]
        key = (cells[0] - self.low[0]) * self.span[1] + (cells[1] - self.low[1])
        order = np.argsort(key, kind="stable")
        self.at, self.keys = self.at[order], key[order]
        self.x, self.y = x[self.at], y[self.at]

    def _rows(self, v: np.ndarray, axis: int) -> np.ndarray:
        """Cells of coordinates, from 0, held just outside the grid where they are beyond it."""
        return np.clip(np.floor(v / self.size) - self.low[axis], -1, self.span[axis]).astype(np.int64)

    def near(self, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float, at_once: int = 1 << 19):
        """(segment, place) pairs in parts: all that are within reach, and others of the cells along the segments."""
        for lo in range(0, len(ax) if len(self.at) else 0, 1 << 16):
            part = slice(lo, lo + (1 << 16))
            for seg, place in self._near(ax[part], ay[part], bx[part], by[part], reach, at_once):
                yield lo + seg, place

    def _near(self, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float, at_once: int):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            west, east = np.minimum(ax, bx), np.maximum(ax, bx)
            ok = np.flatnonzero(np.isfinite(west + east + ay + by))
            first = np.maximum(self._rows(west[ok] - reach, 0), 0)
            n = np.maximum(np.minimum(self._rows(east[ok] + reach, 0), self.span[0] - 1) - first + 1, 0)
            seg = np.repeat(ok, n)
            column = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            edge = (column + self.low[0]) * self.size
            # the part of the segment over a column of cells bounds the rows
            slope = (by[seg] - ay[seg]) / (bx[seg] - ax[seg])
            y0 = ay[seg] + (np.maximum(west[seg], edge - reach) - ax[seg]) * slope
            y1 = ay[seg] + (np.minimum(east[seg], edge + self.size + reach) - ax[seg]) * slope
            upright = ~np.isfinite(y0 + y1)
            y0, y1 = np.where(upright, ay[seg], y0), np.where(upright, by[seg], y1)
            lo = np.maximum(self._rows(np.minimum(y0, y1) - reach, 1), 0)
            hi = np.minimum(self._rows(np.maximum(y0, y1) + reach, 1), self.span[1] - 1)
        begin = np.searchsorted(self.keys, column * self.span[1] + lo, "left")
        size = np.where(hi >= lo, np.searchsorted(self.keys, column * self.span[1] + hi, "right") - begin, 0)
        for k, at in expanded(size, at_once):
            yield seg[k], begin[k] + at


def expanded(size: np.ndarray, at_once: int = 1 << 19):
    """(item, number from 0) for each of the size[item] parts of all items, about so many at a time."""
    done = np.cumsum(size)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + at_once, "right")))
        n = size[lo:hi]
        k = np.repeat(np.arange(lo, hi), n)
        yield k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
        lo = hi


def dense(points: np.ndarray, eps: float, at_least: int, strict: bool = False, group: np.ndarray | None = None) -> np.ndarray:
    """Whether so many points of its group, itself included, are within eps of each point."""
    out = np.ones(len(points), bool)
    if len(points):
        grid = Grid(points, eps, group)
        out[grid.order] = _core(grid, at_least, strict)
    return out


def _core(grid: Grid, at_least: int, strict: bool = False) -> np.ndarray:
    few = grid.count < at_least
    near = np.where(few, 0, at_least)[grid.cell]
    for i, j in grid.compared(*grid.around(few)):
        ok = grid.within(i, j, strict)
        near += np.bincount(i[ok], minlength=len(near))
    return near >= at_least


def density_labels(points: np.ndarray, eps: float, at_least: int, group: np.ndarray | None = None) -> np.ndarray:
    """Density clusters: core points with enough points within eps, joined where adjacent.

    Clusters are numbered by their first core point, in each group from 0; a point beside several gets
    the lowest number, others get -1.
    """
    n = len(points)
    label = np.full(n, -1)
    if not n:
        return label
    grid = Grid(points, eps, group)
    core = _core(grid, at_least)
    cores = np.bincount(grid.cell[core], minlength=len(grid.keys))
    up = list(range(len(grid.keys)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    a, b = grid.pairs.T
    live = (cores[a] > 0) & (cores[b] > 0)
    a, b = a[live], b[live]
    small = grid.count[a] * grid.count[b] <= 4096
    for i, j in grid.compared(a[small], b[small]):
        ok = core[i] & core[j] & grid.within(i, j)
        for x, y in set(zip(grid.cell[i[ok]].tolist(), grid.cell[j[ok]].tolist(), strict=True)):
            up[root(x)] = root(y)
    for x, y in zip(a[~small].tolist(), b[~small].tolist(), strict=True):
        if root(x) != root(y) and _touch(grid, core, x, y):
            up[root(x)] = root(y)
    comp = np.array([root(x) for x in range(len(up))])
    first = np.full(len(up), n)
    np.minimum.at(first, comp[grid.cell[core]], grid.order[core])  # each cluster's first core point
    rank = np.full(len(up), -1)
    live = np.flatnonzero(first < n)
    rank[live[np.argsort(first[live], kind="stable")]] = np.arange(len(live))
    found = np.where(core, rank[comp[grid.cell]], n)
    for i, j in grid.compared(*grid.around(grid.count < at_least)):
        ok = ~core[i] & core[j] & grid.within(i, j)
        np.minimum.at(found, i[ok], found[j[ok]])
    label[grid.order] = np.where(found < n, found, -1)
    if group is not None:  # clusters of earlier groups come first
        lowest = np.full(int(group.max()) + 1, n)
        np.minimum.at(lowest, group[label >= 0], label[label >= 0])
        label[label >= 0] -= lowest[group[label >= 0]]
    return label


def _touch(grid: Grid, core: np.ndarray, x: int, y: int) -> bool:
    """Whether a core point of one cell is within eps of one of the other."""
    i, j = (np.arange(grid.begin[c], grid.begin[c] + grid.count[c]) for c in (x, y))
    p, q = grid.points[i[core[i]]], grid.points[j[core[j]]]
    # the nearest points first: by their distance to the middle of the other cell's points
    p, q = (u[np.argsort(((u - v.mean(axis=0)) ** 2).sum(axis=1))] for u, v in ((p, q), (q, p)))
    for lo in range(0, len(p), 256):
        for at in range(0, len(q), 1024):
            if (((p[lo : lo + 256, None] - q[None, at : at + 1024]) ** 2).sum(axis=2) <= grid.eps**2).any():
                return True
    return False


def sphere(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Points on the unit sphere: places a great-circle distance apart are its chord apart."""
    a, b = np.radians(lat), np.radians(lon)
    return np.column_stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)])


def chord(metres: float) -> float:
    from roadloom.functions.geo import EARTH_M

    return float(2 * np.sin(metres / (2 * EARTH_M)))


def cluster_planar(xy: np.ndarray, eps: float, at_least: int) -> np.ndarray:
    return density_labels(xy, eps, at_least)


def low_pass(y: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """First-order filter with a weight per sample; starts at the first sample."""
    out, x = [], None
    for v, w in zip(np.asarray(y, float).tolist(), np.asarray(alpha, float).tolist(), strict=True):
        x = v if x is None else x + w * (v - x)
        out.append(x)
    return np.array(out)


def steady_up(acc: np.ndarray, gyro: np.ndarray, t: np.ndarray, warm: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Vertical acceleration and rotation after turning the axes to gravity.

    acc, gyro: (n, 3) samples, t: seconds. The two turning angles follow the smoothed gravity vector;
    during the first ``warm`` samples where it looks like gravity alone, later where the turned
    vertical is off by more than 0.15 g. Needs more than ``warm`` samples.
    """
    dt = np.diff(t, prepend=t[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        smooth, follow = (np.nan_to_num(dt / (c + dt)) for c in (0.5, 0.03))
    a = np.column_stack([low_pass(acc[:, k], smooth) for k in range(3)])
    g = np.column_stack([low_pass(gyro[:, k], smooth) for k in range(3)])
    flat = np.hypot(a[:, 1], a[:, 2])
    full = np.sqrt(flat**2 + a[:, 0] ** 2)
    still = (flat < 1.3) & (full > 0.7)
    with np.errstate(divide="ignore", invalid="ignore"):
        wanted = np.column_stack([a[:, 1] / flat, a[:, 2] / flat, a[:, 0] / full, flat / full])
    turn = np.empty((len(t), 4))  # sin and cos of the first angle, then of the second
    turn[0] = (0.0, 1.0, 0.0, 1.0)
    up = np.empty(len(t))

    def vertical(v, c):
        return (v[2] * c[1] + v[1] * c[0]) * c[3] + v[0] * c[2]

    up[0] = vertical(a[0], turn[0])
    for i in range(1, len(t)):
        moving = still[i] if i < warm else not 0.85 <= up[i - 1] <= 1.15
        turn[i] = follow[i] * wanted[i] + (1 - follow[i]) * turn[i - 1] if moving else turn[i - 1]
        up[i] = vertical(a[i], turn[i])
    spin = (g[:, 2] * turn[:, 1] + g[:, 1] * turn[:, 0]) * turn[:, 3] + g[:, 0] * turn[:, 2]
    return up, spin


def parzen(n: int) -> np.ndarray:
    """The Parzen window of n points."""
    k = np.abs(np.arange(n) - (n - 1) / 2) / (n / 2)
    return np.where(k <= 0.5, 1 - 6 * k**2 + 6 * k**3, 2 * (1 - k) ** 3)


def smooth_centred(y: np.ndarray, window: int) -> np.ndarray:
    """Centred weighted mean where the whole window fits, then the nearest such value."""
    w = parzen(window)
    out = np.full(len(y), np.nan)
    if len(y) >= window:
        mid = np.convolve(y, w / w.sum(), "valid")
        at = window // 2
        out[at : at + len(mid)] = mid
    return hold(out)


def amplitude(y: np.ndarray, window: int) -> np.ndarray:
    """Largest minus smallest value of a centred window where it is whole and has no gap, then the nearest such value."""
    out = np.full(len(y), np.nan)
    if len(y) >= window:
        parts = np.lib.stride_tricks.sliding_window_view(y, window)
        out[window // 2 : window // 2 + len(parts)] = parts.max(axis=1) - parts.min(axis=1)
    return hold(out)


def hold(y: np.ndarray) -> np.ndarray:
    """Fills gaps with the value before, those at the start with the first value."""
    ok = ~np.isnan(y)
    if not ok.any():
        return y
    at = np.maximum.accumulate(np.where(ok, np.arange(len(y)), -1))
    return np.where(at >= 0, y[np.maximum(at, 0)], y[np.argmax(ok)])


def spectrum(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies from 0 and amplitudes of an evenly sampled series."""
    n = len(y)
    f = np.fft.fftfreq(n, (t.max() - t.min()) / (n - 1))
    a = np.abs(np.fft.fft(y) / n)
    order = np.argsort(f, kind="stable")
    order = order[f[order] >= 0]
    return f[order], a[order]


def curve(x: np.ndarray, y: np.ndarray, times: np.ndarray, degree: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """A polynomial through values that count so many times, sampled about every step from the first x to the last; nothing for too few."""
    n = int(x.max() / step) if len(x) else 0
    if n < 1 or len(np.unique(x)) <= degree:
        return np.zeros(0), np.zeros(0)
    at = np.linspace(x.min(), x.max(), n)
    rcond = times.sum() * np.finfo(float).eps  # of as many points as they stand for
    return at, np.polynomial.Polynomial.fit(x, y, degree, rcond=rcond, w=np.sqrt(times))(at)
