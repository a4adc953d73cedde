"""Boosted trees against a plain exact booster, staged validation against separate fits, the information coefficient against all grids."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadloom.functions import information
from roadloom.operators import boosting, learning


def plain_boost(x, y, p, rounds):
    """Exact greedy trees, a node at a time; margins of the rows after each round, and the trees as functions."""
    margin, stages, trees = np.zeros(len(y)), [], []
    cuts = [(lambda v: (v[1:] + v[:-1]) / 2)(np.unique(c[~np.isnan(c)])) for c in x.T]

    def weight(g, h):
        return -np.sign(g) * max(abs(g) - p.alpha, 0) / (h + p.lam) * p.rate

    def score(g, h):
        return max(abs(g) - p.alpha, 0) ** 2 / (h + p.lam)

    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)

        def grow(rows, depth):
            gs, hs = g[rows].sum(), h[rows].sum()
            node = {"value": weight(gs, hs)}
            best = None
            if depth < p.depth:
                for missing_left in (True, False):
                    side = None
                    for f in range(x.shape[1]):
                        v = x[rows, f]
                        for c in cuts[f]:
                            left = np.where(np.isnan(v), missing_left, v <= c)
                            gl, hl = g[rows][left].sum(), h[rows][left].sum()
                            if hl < p.child or hs - hl < p.child:
                                continue
                            gain = score(gl, hl) + score(gs - gl, hs - hl) - score(gs, hs)
                            if side is None or gain > side[0] + 1e-10:
                                side = (gain, f, c, missing_left, left)
                    if side and side[0] > 1e-6 and (best is None or side[0] > best[0] + 1e-10):
                        best = side
            if best:
                gain, f, c, ml, left = best
                a, b = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
                if gain >= p.gamma or "feature" in a or "feature" in b:
                    node |= {"feature": f, "cut": c, "ml": ml, "kids": (a, b)}
            return node

        root = grow(np.arange(len(y)), 0)
        trees.append(root)
        margin = margin + np.array([walk(root, row) for row in x])
        stages.append(margin)
    return stages, trees


def walk(node, row):
    while "feature" in node:
        v = row[node["feature"]]
        node = node["kids"][0 if (node["ml"] if np.isnan(v) else v <= node["cut"]) else 1]
    return node["value"]


def data(n=160, seed=3):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 25, n), np.round(rng.normal(size=n), 1), rng.integers(0, 3, n), rng.integers(0, 40, n)]).astype(float)
    y = ((x[:, 0] > 12) ^ (x[:, 2] == 1) ^ (rng.random(n) < 0.15)).astype(int)
    x[rng.random(n) < 0.2, 3] = np.nan
    return x, y


def frame(spark, x, y, fold=None):
    rows = [(i, *(None if math.isnan(v) else float(v) for v in r), int(t), int(fold[i]) if fold is not None else 0) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "i int, a double, b double, c double, d double, label int, fold int").repartition(3)


@pytest.mark.parametrize("more", [{}, {"gamma": 2.0, "alpha": 0.7, "child": 3.0}])
def test_splits_equal_an_exact_booster(spark, more):
    x, y = data()
    p = boosting.Params(rounds=3, depth=3, rate=0.4, **more)
    stages, _ = plain_boost(x, y, p, 3)
    df = frame(spark, x, y)
    model = boosting.fit(df, "label", ["a", "b", "c", "d"], rounds=3, depth=3, rate=0.4, **more)
    again = boosting.Booster.loads(model.dumps())
    got = np.array([r.proba for r in again.score(df).orderBy("i").collect()])
    assert np.allclose(got, 1 / (1 + np.exp(-stages[-1])), atol=1e-9)
    assert len(model.trees) == 3 and max(len(t.feature) for t in model.trees) > 3


def test_folds_grow_together(spark):
    x, y = data(200, 5)
    fold = np.arange(200) % 3
    p = boosting.Params(rounds=3, depth=2, rate=0.5)
    aucs, best = boosting.cross_validated(frame(spark, x, y, fold), "label", ["a", "b", "c", "d"], "fold", 3, rounds=3, depth=2, rate=0.5)
    for f in range(3):
        _, trees = plain_boost(x[fold != f], y[fold != f], p, 3)
        held, truth, margin = x[fold == f], y[fold == f], 0.0
        for r, tree in enumerate(trees):
            margin = margin + np.array([walk(tree, row) for row in held])
            pos, neg = margin[truth == 1], margin[truth == 0]
            auc = ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()
            assert abs(aucs[r][f] - auc) < 0.02, (r, f)  # cuts of all rows, not of the fold's, may lie elsewhere
    assert best == int(np.argmax([np.mean(a) for a in aucs])) + 1 and boosting.rounds_for_all(80) == 100


def test_draws_of_rows_and_columns(spark):
    x, y = data(150, 7)
    df = frame(spark, x, y)
    model = boosting.fit(df, "label", ["a", "b", "c", "d"], rounds=2, depth=2, rows=0.7, columns=0.5)
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for t in model.trees)
    out = model.score(df.withColumn("a", F.lit(None).cast("double"))).collect()
    assert len(out) == 150 and all(0 < r.proba < 1 for r in out)
    empty = boosting.fit(df.where("false"), "label", ["a"], rounds=1)
    assert {r.proba for r in empty.score(df).collect()} == {0.5}


def test_stops_without_a_better_round(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 5, (60, 4)).astype(float), rng.integers(0, 2, 60)
    aucs, best = boosting.cross_validated(frame(spark, x, y, np.arange(60) % 2), "label", ["a"], "fold", 2, patience=1, rounds=8, depth=1)
    assert len(aucs) < 8 and best <= len(aucs)


# ---- information coefficient -----------------------------------------------------------------------


def plain_rows(values, parts):
    """Rows of a grid for points by value, ties together."""
    order, out, row, held, done, n = sorted(set(values)), {}, 0, 0, 0, len(values)
    aim = n / parts
    for v in order:
        k = values.count(v)
        if held and abs(held + k - aim) >= abs(held - aim):
            row, held, aim = row + 1, 0, (n - done) / max(1, parts - row - 1)
        out[v], held, done = row, held + k, done + k
    return [out[v] for v in values]


def plain_mic(x, y):
    """All partitions of the columns."""
    n, best = len(x), 0.0
    cells = int(max(n**0.6, 4))
    for a, b in ((x, y), (y, x)):
        for q in range(2, cells // 2 + 1):
            row = plain_rows(list(b), q)
            if max(row) == 0:
                continue
            steps = sorted(set(a))
            for cols in range(2, cells // q + 1):
                for cut in itertools.combinations(steps[1:], min(cols - 1, len(steps) - 1)):
                    col = [sum(v >= c for c in cut) for v in a]
                    mi = 0.0
                    for c in set(col):
                        for r in set(row):
                            k = sum(1 for i in range(n) if col[i] == c and row[i] == r)
                            if k:
                                mi += k / n * math.log2(k * n / (col.count(c) * row.count(r)))
                    best = max(best, mi / math.log2(min(cols, q)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_coefficient_equals_all_grids(seed):
    rng = np.random.default_rng(seed)
    n = 26
    x = rng.integers(0, 12, n) if seed % 2 else rng.permutation(n)
    y = [x // 3, (x - 6) ** 2, rng.integers(0, 2, n), rng.integers(0, 9, n), x % 4, (x > 5).astype(int)][seed]
    pairs, count = np.unique(np.column_stack([x, y]), axis=0, return_counts=True)
    got = information.coefficient(pairs[:, 0], pairs[:, 1], count.astype(float))
    assert abs(got - plain_mic(x.tolist(), np.asarray(y).tolist())) < 1e-9


def test_known_coefficients():
    at = np.arange(300)
    one = np.ones(300)
    assert information.coefficient(at, at, one) == pytest.approx(1) and information.coefficient(at, (at - 150) ** 2, one) > 0.9
    assert information.coefficient(at, np.zeros(300), one) == 0.0 and information.coefficient(at[:0], at[:0], one[:0]) == 0.0
    rng = np.random.default_rng(2)
    assert information.coefficient(rng.permutation(300), rng.permutation(300), one) < 0.35


def test_coefficients_of_a_frame(spark):
    rng = np.random.default_rng(4)
    n = 400
    y = rng.integers(0, 2, n)
    cols = {"told": y * 2.0 + 1, "half": np.where(rng.random(n) < 0.5, y, rng.random(n)), "noise": rng.random(n), "flat": np.ones(n)}
    rows = [(int(y[i]), *(float(c[i]) for c in cols.values())) for i in range(n)] + [(None, 1.0, 1.0, 1.0, 1.0), (1, None, None, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"{c} double" for c in cols)).repartition(4)
    for values in (1000, 60):  # the columns of many values by their quantiles
        got = {r["name"]: r["rank"] for r in learning.information_coefficients(df, "y", list(cols), values=values).collect()}
        assert got["told"] == pytest.approx(1, abs=0.01) and got["flat"] == 0 and 0.15 < got["half"] < 0.9 and got["noise"] < got["half"]
        if values == 1000:
            for c in ("half", "noise"):
                assert got[c] == pytest.approx(information.coefficient(cols[c], y, np.ones(n), most_cells=200))


def test_trees_of_rounds_are_in_one_pass(spark, monkeypatch):
    """Margins are written every few rounds; before that a pass goes through Python once, whatever the round. Nine features take two numbers."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(500, 9)), 1)
    y = (x[:, 0] + x[:, 8] + rng.normal(size=500) * 0.3 > 0).astype(int)
    names = [f"c{i}" for i in range(9)]
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], [*names, "label"]).coalesce(1)
    told = []
    for keep in (10, 2):
        monkeypatch.setattr(boosting, "KEEP", keep)
        t = boosting.Training(df, "label", names, boosting.Params(rounds=5, depth=3), None, 1)
        for r in range(5):
            t.round(r)
            assert str(t.rows._jdf.queryExecution().optimizedPlan()).count("MapInArrow") == 0
        told.append(boosting.Booster(names, t.edges, t.trees[0]).score(df).select("proba").toPandas().proba.to_numpy())
    assert np.allclose(*told) and boosting.auc_of_counts(np.column_stack([np.bincount((told[0] * 99).astype(int)[y == k], minlength=100) for k in (0, 1)])) > 0.95


def test_few_and_many_values(spark):
    """Cuts lie between values where there are few, missing ones and NaN aside, and at quantiles from BINS values on."""
    df = spark.range(2000).select((F.col("id") % 63).cast("double").alias("few"), (F.col("id") % 64).cast("double").alias("many"), F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).when(F.col("id") % 3 == 0, F.col("id") % 4).alias("gaps"), F.lit(None).cast("double").alias("none")).repartition(5)
    few, many, gaps, none = boosting.edges_of(df, ["few", "many", "gaps", "none"])
    assert few.tolist() == [k + 0.5 for k in range(62)] and gaps.tolist() == [2.0] and len(none) == 0
    assert len(many) == 62 and set(many) <= set(map(float, range(64)))
