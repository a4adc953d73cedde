"""Cleaning of trip points: date gate and keep-last de-duplication.

All windows and aggregates of a trip are keyed by TrackId, so one exchange serves them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY, ORDER = "TrackId", ["PointDate", "RowId"]


def by_trip(*more: str) -> Window:
    return Window.partitionBy(KEY, *more)


def in_order() -> Window:
    return by_trip().orderBy(*ORDER)


def with_row_id(points: DataFrame) -> DataFrame:
    """A tie-breaker where the input has none: the file's sequence number, else the row's content."""
    if "RowId" in points.columns:
        return points
    if "Number" in points.columns:
        return points.withColumn("RowId", F.coalesce(F.col("Number"), F.xxhash64(*points.columns)))
    return points.withColumn("RowId", F.xxhash64(*points.columns))


def date_gate(points: DataFrame, after: str = "2015-01-01") -> DataFrame:
    return points.where(F.col("PointDate") > F.lit(after).cast("timestamp_ntz"))


def deduplicate(points: DataFrame) -> DataFrame:
    """Keeps the latest row of each place of a trip, then the last row of each moment."""

    def last(df: DataFrame, *cols: str) -> DataFrame:
        w = by_trip(*cols).orderBy(F.col("PointDate").desc(), F.col("RowId").desc())
        return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

    return last(last(points, "Latitude", "Longitude"), "PointDate")


def keep_large_groups(points: DataFrame, group: str, more_than: int = 4) -> DataFrame:
    """Rows of groups with more rows than that."""
    return points.withColumn("__n", F.count("*").over(by_trip(group))).where(F.col("__n") > more_than).drop("__n")


def drop_last(points: DataFrame, n: int = 100) -> DataFrame:
    w = by_trip().orderBy(F.col("PointDate").desc(), F.col("RowId").desc())
    return points.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > n).drop("__n")
