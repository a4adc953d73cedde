"""Recursions along a trip that no single task has to hold.

A first-order filter is a chain of affine steps x -> a * x + b, and steps compose to steps of the same
kind. Rows are dealt by ranges of (trip, time), each range is scanned alone by doubling distances, and
what a range needs of those before it is one value, found from one row a partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators.grouped import changes
from roadloom.session import materialised


def composed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the composition of all steps up to it; a step with a = 0 forgets what was before."""
    a, b = a.copy(), b.copy()
    by = 1
    while by < len(a):
        live = np.flatnonzero(a[by:]) + by
        before = live - by
        b[live], a[live] = a[live] * b[before] + b[live], a[live] * a[before]
        by *= 2
    return a, b


def _weight(dt: np.ndarray, tau: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.where(dt > 0, dt / (tau + np.abs(dt)), 0.0)


def first_order(points: DataFrame, column: str, tau: float, key: str = "TrackId", order: tuple[str, str] = ("PointDate", "RowId")) -> DataFrame:
    """(key, second order column, smooth): the filter with the weight dt / (tau + dt) of each step along order.

    It starts at a key's first value; steps of no time leave it as it is; a missing value makes the rest of its key NaN.
    """
    kinds = dict(points.dtypes)
    time, tie = order
    schema = f"`{key}` {kinds[key]}, `{tie}` {kinds[tie]}, __t bigint, __v double, __a double, __b double, __nth bigint, __part int"
    rows = points.select(F.col(key), F.col(tie), F.unix_micros(F.col(time).cast("timestamp")).alias("__t"), F.col(column).cast("double").alias("__v"))
    by = [F.col(key), F.col("__t"), F.col(tie)]
    n = max(1, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches):
        part = TaskContext.get().partitionId()
        done, last, t_last, a_last, b_last = 0, None, 0, 1.0, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            t, v = b.column(2).to_numpy(zero_copy_only=False), b.column(3).to_numpy(zero_copy_only=False)
            fresh = np.zeros(b.num_rows, bool)
            fresh[changes(b, 1)] = True
            here = b.column(0)[0].as_py()
            fresh[0] = done > 0 and here != last
            w = _weight(np.diff(t, prepend=t_last if done else t[0]) / 1e6, tau)
            a, x = np.where(fresh, 0.0, 1 - w), np.where(fresh, v, np.where(w > 0, w * v, np.where(np.isnan(v), v, 0.0)))
            if not done:
                a[0], x[0] = 1.0, 0.0  # the range's first row is what the ranges before it will tell
            elif a[0]:
                a[0], x[0] = a[0] * a_last, a[0] * b_last + x[0]
            a, x = composed(a, x)
            last, t_last, a_last, b_last = b.column(0)[b.num_rows - 1].as_py(), t[-1], a[-1], x[-1]
            cols = [b.column(0), b.column(1), b.column(2), b.column(3), pa.array(a), pa.array(x), pa.array(np.arange(done, done + len(t))), pa.array(np.full(len(t), part, np.int32))]
            done += len(t)
            yield pa.RecordBatch.from_arrays(cols, names=[key, tie, "__t", "__v", "__a", "__b", "__nth", "__part"])

    scanned = materialised(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).mapInArrow(scan, schema))
    ends = scanned.groupBy("__part").agg(F.min_by(F.struct(F.col(key).alias("k"), "__t", "__v"), "__nth").alias("head"), F.max_by(F.struct(F.col(key).alias("k"), "__t", "__a", "__b"), "__nth").alias("tail"))
    begin, before = [], None
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):  # a row a partition
        (k0, t0, x), (k1, t1, a, b) = r["head"], r["tail"]
        x = float("nan") if x is None else x
        if before is not None and before[0] == k0:
            w = float(_weight(np.array((t0 - before[1]) / 1e6), tau))
            x = before[2] + w * (x - before[2])
        begin.append((r["__part"], x))
        before = (k1, t1, (a * x if a else 0.0) + b)
    small = points.sparkSession.createDataFrame(begin, "__part int, __x double")  # a row a partition
    smooth = F.when(F.col("__a") == 0, F.col("__b")).otherwise(F.col("__a") * F.col("__x") + F.col("__b"))
    return scanned.join(F.broadcast(small), "__part").select(key, tie, smooth.alias("smooth"))
