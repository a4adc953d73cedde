"""Per-trip features from points and headers, each as one aggregation over prepared rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.stats import density_histogram, ratio, seconds
from roadloom.operators.prep import in_order
from roadloom.schema import HEADER_FEATURES

# Bin edges of the feature histograms.
SPEED_EDGES = [0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 100, 130, 160, 300]
ACC_EDGES = [-23, -20, -17, -14, -11, -8, -5, -2, 1, 4, 7, 10, 13, 16, 19, 22, 25]
STOP_EDGES = [5, 10, 25, 40, 60, 90, 120, 180, 600]
MOVE_EDGES = [10, 100, 250, 500, 1000, 1500, 2033, 3033, 4033, 10000, 20000, 30000, 60000, 180000]


def acceleration(points: DataFrame) -> DataFrame:
    """Adds acc, km/h a second against the row before; 0 for the first row and where time doesn't advance."""
    w = in_order()
    dt = seconds(F.col("PointDate"), F.lag("PointDate").over(w))
    dv = F.col("Speed") - F.lag("Speed").over(w)
    return points.withColumn("acc", F.when(dt > 0, F.try_divide(dv, dt)).otherwise(F.lit(0.0)))


def _median_std(value, name: str) -> list:
    return [F.mean(value).alias(f"{name}_mean"), F.median(value).alias(f"{name}_median"), F.stddev_samp(value).alias(f"{name}_std")]


def speed_aggregates() -> list:
    """Speed: densities over the car part, statistics over the whole trip."""
    v = F.col("Speed")
    return [
        *density_histogram(v, SPEED_EDGES, "v", F.col("is_car")),
        F.median(v).alias("speed_median"),
        F.mean(v).alias("speed_mean"),
        F.stddev_samp(v).alias("speed_std"),
        F.max(v).alias("speed_max"),
    ]


def acceleration_aggregates() -> list:
    a = F.col("acc")
    return [
        *density_histogram(a, ACC_EDGES, "a"),
        F.mean(a).alias("acc_mean"),
        F.stddev_samp(a).alias("acc_std"),
        *_median_std(F.when(a > 0, a), "acc_pos"),
        *_median_std(F.when(a < 0, -a), "acc_neg"),
    ]


def total_aggregates() -> list:
    walk = F.when(F.col("is_walk"), F.col("TotalMeters"))
    return [
        seconds(F.max("PointDate"), F.min("PointDate")).alias("total_secs"),
        F.max("TotalMeters").alias("total_dist"),
        (F.max(walk) - F.min(walk)).alias("pedestrian_dist"),
    ]


def stop_aggregates() -> list:
    """Stops of the car part; medians and deviations are shares of its duration."""
    moment = F.when(F.col("is_car"), F.col("PointDate"))
    total = seconds(F.max(moment), F.min(moment))
    s = F.when((F.col("stop_s") > STOP_EDGES[0]) & (F.col("stop_s") < STOP_EDGES[-1]), F.col("stop_s"))
    return [
        ratio(F.coalesce(F.sum("stop_s"), F.lit(0.0)), total).alias("rel_stand_time"),
        F.count(s).alias("nstops"),
        ratio(F.median(s), total).alias("rel_stand_time_median"),
        ratio(F.stddev_pop(s), total).alias("rel_stand_time_std"),
        *density_histogram(s, STOP_EDGES, "st_t"),
    ]


def move_rows(points: DataFrame) -> DataFrame:
    """Adds car_m, the length of the car part, and move, the moves that count.

    Where a trip's moves sum to nothing its whole length is its one move, put on its first row.
    """
    w = Window.partitionBy("TrackId")
    df = points.withColumn("car_m", F.max(F.when(F.col("is_car"), F.col("TotalMeters"))).over(w))
    none = F.coalesce(F.sum("move_m").over(w), F.lit(0.0)) == 0
    move = F.when(none, F.when(F.col("n") == 1, F.col("car_m"))).otherwise(F.col("move_m"))
    return df.withColumn("move", F.when((move > MOVE_EDGES[0]) & (move < MOVE_EDGES[-1]), move))


def move_aggregates() -> list:
    total = F.max("car_m")
    return [ratio(F.median("move"), total).alias("rel_move_len_median"), ratio(F.stddev_pop("move"), total).alias("rel_move_len_std"), *density_histogram(F.col("move"), MOVE_EDGES, "mv_d")]


def interpolate(df: DataFrame, column: str, order: list[str] | None = None) -> DataFrame:
    """Fills nulls on a line between the values around them, by position; later ones by the last value."""
    w = Window.partitionBy("TrackId").orderBy(*(order or ["RowId"]))
    at = F.row_number().over(w)
    known = F.when(F.col(column).isNotNull(), F.struct(F.col("__at").alias("at"), F.col(column).alias("v")))
    df = df.withColumn("__at", at)
    df = df.withColumn("__a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("__b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    step = F.try_divide((F.col("__at") - F.col("__a.at")) * (F.col("__b.v") - F.col("__a.v")), F.col("__b.at") - F.col("__a.at"))
    return df.withColumn(column, F.coalesce(column, F.col("__a.v") + step, F.col("__a.v"))).drop("__at", "__a", "__b")


def rich_features(points: DataFrame) -> DataFrame:
    """Features of map-matched points: origin, height, speeding, and when the trip began."""
    df = points.withColumn("__t", F.unix_micros(F.col("PointDate").cast("timestamp")).cast("double"))
    df = interpolate(interpolate(df, "Height"), "__t").fillna(0, ["Height", "Speed", "SpeedLimit"])
    limit = F.col("SpeedLimit")
    over = F.when(limit == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("Speed"), limit))
    over = F.when(over > 1, over)
    start = F.timestamp_micros(F.min("__t").cast("long"))
    h = F.col("Height")
    return df.groupBy("TrackId").agg(
        F.avg(F.coalesce(F.col("FromSource"), F.lit(False)).cast("double")).alias("rel_from_device"),
        F.avg(F.coalesce(F.col("Urban"), F.lit(False)).cast("double")).alias("rel_urban"),
        F.min(h).alias("height_min"), F.max(h).alias("height_max"), F.mean(h).alias("height_mean"), F.median(h).alias("height_median"), F.stddev_pop(h).alias("height_std"),
        F.coalesce(F.max(over), F.lit(1.0)).alias("rel_overspeed_max"),
        F.coalesce(F.mean(over), F.lit(1.0)).alias("rel_overspeed_mean"),
        F.coalesce(F.median(over), F.lit(1.0)).alias("rel_overspeed_median"),
        F.coalesce(F.stddev_pop(over), F.lit(0.0)).alias("rel_overspeed_std"),
        F.dayofmonth(start).alias("day"), F.weekday(start).alias("weekday"), F.hour(start).alias("hour"), F.minute(start).alias("minute"),
    )


def header_features(tracks: DataFrame, per_device: bool = False) -> DataFrame:
    """Header columns that are features, and the number of trips of the same day and whether it is odd.

    The number counts all devices of the frame unless per_device is set. The days' counts are
    aggregated first and joined back, so one busy day doesn't gather in a task.
    """
    cols = [c for c in HEADER_FEATURES if c in tracks.columns]
    day = tracks.select("Id", "IncomingTrackId", "DeviceToken", F.to_date("StartDate").alias("__day"), *cols)
    keys = ["__day", "DeviceToken"] if per_device else ["__day"]
    counts = day.groupBy(*keys).agg(F.count("*").alias("trips_per_day"))
    kinds = dict(day.dtypes)
    plain = [F.coalesce(F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c), F.lit(0)).alias(c) for c in cols]
    out = day.join(counts, keys).select(F.col("Id").alias("TrackId"), "IncomingTrackId", *plain, "trips_per_day", (F.col("trips_per_day") % 2).alias("trips_odd"))
    return out.dropDuplicates()
