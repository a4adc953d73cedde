"""Operators on phone sensors: orientation, stationary positions, gravity, parking, spectrum."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import kernels
from roadloom.functions.geo import angle, haversine_m, planar
from roadloom.functions.stats import seconds
from roadloom.operators.grouped import map_groups, spans
from roadloom.operators.prep import in_order
from roadloom.operators.scans import first_order
from roadloom.operators.segments import longest_run
from roadloom.session import materialised

ACC = ["AccelerationXOriginal", "AccelerationYOriginal", "AccelerationZOriginal"]
GYRO = ["GyroscopeXOriginal", "GyroscopeYOriginal", "GyroscopeZOriginal"]


def norm(columns: list[str]):
    return F.sqrt(sum((F.pow(F.col(c), 2) for c in columns), F.lit(0.0)))


def orientation(points: DataFrame, acc: list[str] | None = None, gyro: list[str] | None = None) -> DataFrame:
    """Adds R (length of the acceleration), theta (its angle to the screen's axis) and angular_velocity."""
    acc, gyro = acc or ACC, gyro or GYRO
    r = norm(acc)
    df = points.withColumn("R", r).withColumn("theta", F.coalesce(F.nanvl(F.degrees(F.acos(F.try_divide(F.col(acc[2]), r))), F.lit(0.0)), F.lit(0.0)))
    return df.withColumn("angular_velocity", norm(gyro)) if all(c in df.columns for c in gyro) else df


def low_pass(points: DataFrame, column: str, tau: float = 0.5) -> DataFrame:
    """(TrackId, RowId, smooth): first-order filter with the weight dt / (tau + dt) of each step.

    It starts at a trip's first value; steps of no time leave it as it is. A trip of any length is spread
    over ranges of time, see ``scans``.
    """
    return first_order(points, column, tau)


def resample_seconds(points: DataFrame, column: str) -> DataFrame:
    """(TrackId, second, value): one row a second, the mean of its samples, others on a line between."""
    return _seconds(points, column).drop("sampled")


def _seconds(points: DataFrame, column: str) -> DataFrame:
    """``resample_seconds`` with sampled: whether the second has samples of its own.

    The seconds up to the next one with samples are made from each of these, whose values around come from
    windows; so no grid of seconds is joined. Its size can't be told before, and it would be sent around as a small one.
    """
    sec = F.date_trunc("second", "PointDate").cast("timestamp_ntz")
    own = points.select("TrackId", sec.alias("second"), F.col(column).alias("v")).groupBy("TrackId", "second").agg(F.mean("v").alias("v"))
    w = Window.partitionBy("TrackId").orderBy("second")
    second = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    known = F.when(F.col("v").isNotNull(), F.struct(second("second").alias("t"), F.col("v").alias("v")))
    own = own.withColumns({"p": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "q": F.first(known, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))})
    step = F.expr("interval 1 second")
    upto = F.coalesce(F.lead("second").over(w) - step, F.col("second"))
    full = own.withColumn("upto", upto).select("TrackId", F.col("second").alias("own"), "v", "p", "q", F.explode(F.sequence("second", "upto", step)).alias("second"))
    at = second("second")
    mid = F.col("p.v") + F.try_divide((at - F.col("p.t")) * (F.col("q.v") - F.col("p.v")), F.col("q.t") - F.col("p.t"))
    here = F.col("second") == F.col("own")
    return full.select("TrackId", "second", F.coalesce(F.when(here, F.col("v")), mid).alias("value"), here.alias("sampled"))


def rolling_amplitude(df: DataFrame, column: str, window: int = 30, order: str = "second") -> DataFrame:
    """Adds amplitude: largest minus smallest value of a centred window where it is whole, else the nearest one's."""
    w = Window.partitionBy("TrackId").orderBy(order)
    frame = w.rowsBetween(-(window // 2), window - window // 2 - 1)
    raw = F.when(F.count(column).over(frame) == window, F.max(column).over(frame) - F.min(column).over(frame))
    df = df.withColumn("__a", raw)
    before = F.last("__a", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("__a", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("amplitude", F.coalesce(before, after)).drop("__a")


def smooth(grid: DataFrame, window: int = 200) -> DataFrame:
    """(TrackId, second, smooth): centred Parzen means of (TrackId, second, value), the nearest one where the window does not fit."""

    def run(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        y = rows.column(2).to_numpy(zero_copy_only=False)
        out = np.concatenate([kernels.smooth_centred(y[a:b], window) for a, b in spans(starts, rows.num_rows)])
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out)], names=["TrackId", "second", "smooth"])

    out = map_groups(grid, ["TrackId"], ["second"], ["second", "value"], f"TrackId {dict(grid.dtypes)['TrackId']}, second timestamp_ntz, smooth double", run)
    return out.withColumn("smooth", F.nanvl("smooth", F.lit(None).cast("double")))


def smooth_theta(points: DataFrame, window: int = 200, amplitude: int = 30) -> DataFrame:
    """Adds smoothed_theta and theta_amplitude to oriented points, by way of a value a second.

    The values of a trip's seconds go through one kernel, and only those of seconds with points come back.
    """

    def run(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        y, here = (rows.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
        smoothed = np.concatenate([kernels.smooth_centred(y[a:b], window) for a, b in spans(starts, rows.num_rows)])
        spread = np.concatenate([kernels.amplitude(smoothed[a:b], amplitude) for a, b in spans(starts, rows.num_rows)])
        at = np.flatnonzero(here)
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), rows.column(1).take(pa.array(at)), pa.array(smoothed[at]), pa.array(spread[at])], names=["TrackId", "second", *names])

    names = ["smoothed_theta", "theta_amplitude"]
    schema = f"TrackId {dict(points.dtypes)['TrackId']}, second timestamp_ntz, " + ", ".join(f"{n} double" for n in names)
    smoothed = map_groups(_seconds(points, "theta"), ["TrackId"], ["second"], ["second", "value", "sampled"], schema, run)
    smoothed = smoothed.withColumns({n: F.nanvl(n, F.lit(None).cast("double")) for n in names})
    out = points.withColumn("second", F.date_trunc("second", "PointDate").cast("timestamp_ntz"))
    return out.join(smoothed.hint("merge"), ["TrackId", "second"]).drop("second")


def positions(points: DataFrame, max_amp: float = 4.0, min_secs: float = 600.0, max_std: float = 3.5) -> DataFrame:
    """Stretches in which the phone lay still: their time, angle, spread and screen direction.

    Two standardised variables have their first principal axis on a diagonal, by the sign of their
    correlation; the product of its components is the screen direction, 0 where one is constant. The
    covariance has that sign too, without a division by deviations that may be 0.
    points: with smoothed_theta and theta_amplitude. A stretch ends before its last row's successor;
    the trip's last row ends a stretch without being part of it.
    """
    w = in_order()
    still = (F.col("theta_amplitude") <= max_amp).cast("int")
    df = points.withColumn("__s", still).withColumn("__n", F.row_number().over(w)).withColumn("__all", F.count("*").over(Window.partitionBy("TrackId")))
    edge = F.coalesce(F.col("__s") != F.lag("__s").over(w), F.lit(True)).cast("int")
    df = df.withColumn("__r", F.sum(edge).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__n < __all and __s = 1")
    inner = Window.partitionBy("TrackId", "__r").orderBy("PointDate", "RowId")
    df = df.withColumn("__dv", F.coalesce(F.col("Speed") - F.lag("Speed").over(inner), F.lit(0.0)))
    z = F.col(ACC[2])
    secs = seconds(F.max("PointDate"), F.min("PointDate"))
    out = df.groupBy("TrackId", "__r").agg(
        F.min("PointDate").alias("start"), F.max("PointDate").alias("end"), secs.alias("time_delta"), F.mean("smoothed_theta").alias("theta_0"),
        F.stddev_samp("smoothed_theta").alias("rstd"), F.max("theta_amplitude").alias("amp"), F.covar_pop("__dv", z).alias("__c"),
    )
    out = out.where((F.col("time_delta") >= min_secs) & ~F.coalesce(F.col("rstd") > max_std, F.lit(False)))
    sign = F.coalesce(F.signum(F.nanvl("__c", F.lit(0.0))), F.lit(0.0))
    return out.withColumn("screen_direction", sign / 2).drop("__r", "__c")


def stationary(points: DataFrame, **limits: float) -> DataFrame:
    """Positions whose screen faces against the motion."""
    return positions(points, **limits).where("screen_direction > 0")


def longest_position(points: DataFrame) -> DataFrame:
    """Per trip, the longest position under wider limits; trips without one get -1 in all columns."""
    found = positions(points, max_amp=10.0, min_secs=300.0, max_std=8.0)
    cols = ["time_delta", "theta_0", "rstd", "amp", "screen_direction"]
    best = found.groupBy("TrackId").agg(*(F.max_by(c, F.struct("time_delta", F.col("start"))).alias(c) for c in cols))
    return points.select("TrackId").distinct().join(best.hint("merge"), "TrackId", "left").fillna(-1.0, cols)


def vertical_features(points: DataFrame) -> DataFrame:
    """(TrackId, z_f0..z_f3): mean and deviation of small vertical rotations and accelerations.

    0 for trips of fewer than 300 samples, without acceleration, or with fewer than 300 small values.
    """

    cols = [*ACC, *GYRO]

    def run(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        t = rows.column(1).to_numpy(zero_copy_only=False).astype("datetime64[us]").astype(np.int64) / 1e6
        xyz = np.column_stack([rows.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(cols))])
        out = np.zeros((len(starts), 4))
        for k, (a, b) in enumerate(spans(starts, rows.num_rows)):
            acc = xyz[a:b, :3]
            if b - a >= 300 and not np.isnan(acc[0, 0]) and acc[:, 0].sum() != 0:
                up, spin = kernels.steady_up(acc, xyz[a:b, 3:], t[a:b] - t[a])
                for j, v in ((0, spin[np.abs(spin) < 0.1]), (2, up[np.abs(up) < 1.0])):
                    if len(v) >= 300:
                        out[k, j : j + 2] = v.mean(), v.std()
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(starts)), *map(pa.array, out.T)], names=["TrackId", *(f"z_f{k}" for k in range(4))])

    schema = f"TrackId {dict(points.dtypes)['TrackId']}, " + ", ".join(f"z_f{k} double" for k in range(4))
    return map_groups(points, ["TrackId"], ["PointDate", "RowId"], ["PointDate", *cols], schema, run)


def parking(walk: DataFrame) -> DataFrame:
    """Per trip: steps of the walking part under 100 m, their sum and number, and the longest run of short ones.

    angle statistics are over the turns between consecutive steps. Distances take latitude and
    longitude in their right places.
    """
    w = in_order()
    lead = lambda c, k: F.lead(c, k).over(w)
    df = walk.withColumn("__n", F.row_number().over(w))
    df = df.withColumn("step", haversine_m(F.col("Latitude"), F.col("Longitude"), lead("Latitude", 1), lead("Longitude", 1)))
    ux, uy = lead("Longitude", 1) - F.col("Longitude"), lead("Latitude", 1) - F.col("Latitude")
    vx, vy = lead("Longitude", 2) - lead("Longitude", 1), lead("Latitude", 2) - lead("Latitude", 1)
    zero = F.lit(0.0)
    cos = F.try_divide(ux * vx + uy * vy, planar(zero, zero, ux, uy) * planar(zero, zero, vx, vy))
    df = df.withColumn("angle", angle(cos))
    short = F.when(F.col("step") < 100, F.col("step"))
    out = df.groupBy("TrackId").agg(F.coalesce(F.sum(short), F.lit(0.0)).alias("steps_m"), F.count(short).alias("n_steps"), F.mean("angle").alias("angle_mean"), F.max("angle").alias("angle_max"))
    steps = df.where("step < 100")
    runs = longest_run(steps, (F.col("step") > 0.5) & (F.col("step") < 30), ["__n"])
    return out.join(runs.hint("merge"), "TrackId", "left").fillna(0, ["longest_run"])


def turn_angles(points: DataFrame) -> DataFrame:
    """(TrackId, RowId, angle): degrees between the steps before and after each inner point."""
    w = in_order()
    lag, lead = (lambda c: F.lag(c).over(w)), (lambda c: F.lead(c).over(w))
    ux, uy = F.col("Longitude") - lag("Longitude"), F.col("Latitude") - lag("Latitude")
    vx, vy = lead("Longitude") - F.col("Longitude"), lead("Latitude") - F.col("Latitude")
    size = F.sqrt(ux * ux + uy * uy) * F.sqrt(vx * vx + vy * vy)
    cos = F.try_divide(ux * vx + uy * vy, size)
    return points.select("TrackId", "RowId", angle(cos).alias("angle")).where("angle is not null")


def taxi_row(points: DataFrame, walk: DataFrame) -> DataFrame:
    """The feature row of a possible taxi: longest position, vertical features and parking."""
    points = materialised(points)  # read by three branches
    return longest_position(points).join(vertical_features(points).hint("merge"), "TrackId").join(parking(walk).hint("merge"), "TrackId", "left")


def spectrum(samples: DataFrame, key: str = "TrackId", gravity: float = 9.81523, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """(key, freq, amp): amplitudes of the acceleration's length around its mean, in g.

    samples: (key, t, X, Y, Z). The mean is taken over all samples, the transform over lo <= t < hi,
    with its first moment as 0.
    """
    df = samples.withColumn("y", norm(["X", "Y", "Z"]) / gravity)
    df = df.withColumn("y", F.col("y") - F.mean("y").over(Window.partitionBy(key)))
    if lo is not None:
        df = df.where(F.col("t") >= lo)
    if hi is not None:
        df = df.where(F.col("t") < hi)
    df = df.withColumn("t", F.col("t") - F.min("t").over(Window.partitionBy(key)))

    def run(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        t, y = (rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        n, found = [], [(np.zeros(0), np.zeros(0))]
        for a, b in spans(starts, rows.num_rows):
            found.append(kernels.spectrum(t[a:b], y[a:b]) if b - a > 1 and t[b - 1] > 0 else found[0])
            n.append(len(found[-1][0]))
        freq, amp = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(np.repeat(starts, n))), pa.array(freq), pa.array(amp)], names=[key, "freq", "amp"])

    return map_groups(df, [key], ["t"], ["t", "y"], f"{key} {dict(samples.dtypes)[key]}, freq double, amp double", run)
