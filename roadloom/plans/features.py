"""The feature plan: points and headers in, one wide row per trip out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators import features as ft
from roadloom.operators import geometry as geo
from roadloom.operators.prep import with_row_id
from roadloom.operators.segments import intervals, split_walk
from roadloom.session import materialised
from roadloom.sources.trips import natural_key


def prepared(track: DataFrame) -> DataFrame:
    """Clean points with all the window columns that the aggregates need."""
    return ft.move_rows(intervals(split_walk(ft.acceleration(track))))


def aggregates() -> list:
    return [*ft.speed_aggregates(), *ft.acceleration_aggregates(), *ft.total_aggregates(), *ft.stop_aggregates(), *ft.move_aggregates()]


def incoming_features(track: DataFrame) -> DataFrame:
    """All features of raw points in one aggregation; nulls and NaN are 0. track: cleaned points."""
    out = prepared(track).groupBy("TrackId").agg(*aggregates())
    return out.fillna(0)


def geo_features(track: DataFrame, stops: DataFrame, ways: DataFrame, sides: DataFrame) -> DataFrame:
    """Features of bus stops and map lines along the trip."""
    line = materialised(geo.simplify(track, 25.0, ["TrackId", "labels"]))
    return geo.bus_stop_features(split_walk(track), stops, sides).join(geo.way_features(geo.coverage(line, ways)), "TrackId")


def driver_features(incoming: DataFrame, rich: DataFrame, tracks: DataFrame, stops: DataFrame | None = None, ways: DataFrame | None = None, sides: DataFrame | None = None) -> DataFrame:
    """One row per incoming trip, columns in natural order; trips without clean points have no row."""
    points = with_row_id(incoming.withColumn("TrackId", F.col("IncomingTrackId")))
    track = geo.clean(points)
    if stops is not None and ways is not None:
        track = materialised(track)  # six branches read the clustered points
    mine = incoming_features(track)
    if stops is not None and ways is not None:
        sides = sides if sides is not None else track.select("TrackId").distinct().withColumn("left", F.lit(False))
        mine = mine.join(geo_features(track, stops, ways, sides), "TrackId").fillna(0)
    matched = ft.rich_features(with_row_id(rich.withColumn("TrackId", F.col("RichTrackId"))))
    info = ft.header_features(tracks)
    wide = matched.join(info, "TrackId").drop("TrackId").join(mine.withColumnRenamed("TrackId", "IncomingTrackId"), "IncomingTrackId")
    names = sorted((c for c in wide.columns if c != "IncomingTrackId"), key=natural_key)
    return wide.select("IncomingTrackId", *(F.col(f"`{c}`") for c in names))
