"""From the three tables of any number of trips to a label per trip."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.operators import learning, rules
from roadloom.operators.prep import with_row_id
from roadloom.plans.features import driver_features
from roadloom.session import materialised


class Maps(NamedTuple):
    """Reference tables; any may be missing."""

    airports: DataFrame | None = None
    stops: DataFrame | None = None
    ways: DataFrame | None = None
    sides: DataFrame | None = None
    allowed: DataFrame | None = None  # DeviceToken


def validate(tracks: DataFrame) -> DataFrame:
    """(IncomingTrackId, error): each trip must be one device's and have one header id."""
    n, m = F.count_distinct(F.lower("DeviceToken")), F.count_distinct("Id")
    error = F.when(n != 1, F.concat(F.lit("got several DeviceTokens "), n.cast("string"))).when(m != 1, F.concat(F.lit("got number of "), m.cast("string"), F.lit(" RichTrackIds, expected 1"))).otherwise("")
    return tracks.groupBy("IncomingTrackId").agg(error.alias("error"))


def predict(incoming: DataFrame, rich: DataFrame, tracks: DataFrame, model: PipelineModel | None = None, maps: Maps = Maps(), columns: dict[str, str] | None = None) -> DataFrame:
    """(IncomingTrackId, RichTrackId, debug_pred, prediction, error) per header row.

    model scores features under plain names; without one no trip is a bus by the model.
    """
    tracks = tracks.withColumn("DeviceToken", F.lower("DeviceToken"))
    ftrs = materialised(driver_features(incoming, rich, tracks, maps.stops, maps.ways, maps.sides))  # scored and joined again
    have = ftrs.columns
    if model is not None:
        scored = learning.score(learning.plain_names(ftrs), model).select("IncomingTrackId", "proba")
        ftrs = ftrs.join(scored, "IncomingTrackId")
    else:
        ftrs = ftrs.withColumn("proba", F.lit(None).cast("double"))
    rail = F.col("rail_frequency") if "rail_frequency" in have else F.lit(None).cast("double")
    common = rules.transport(F.col("speed_max"), F.col("proba"), F.col("DistanceGPS"), rail)
    labels = ftrs.select("IncomingTrackId", common.alias("common"), F.lit(True).alias("has"))
    points = with_row_id(incoming.withColumn("TrackId", F.col("IncomingTrackId")))
    bike = rules.bicycle(points).withColumnRenamed("TrackId", "IncomingTrackId")
    head = tracks.select("Id", "IncomingTrackId", "DeviceToken", "CompanyId").dropDuplicates(["IncomingTrackId"])
    out = head.join(validate(tracks), "IncomingTrackId").join(labels, "IncomingTrackId", "left").join(bike, "IncomingTrackId", "left")
    if maps.airports is not None:
        taxi = rules.airport_taxi(with_row_id(rich.withColumn("TrackId", F.col("RichTrackId"))), maps.airports)
        out = out.join(taxi.withColumnRenamed("TrackId", "Id"), "Id", "left")
    else:
        out = out.withColumn("taxi", F.lit(0))
    if maps.allowed is not None:
        allowed = maps.allowed.select(F.lower("DeviceToken").alias("DeviceToken"), F.lit(True).alias("allowed")).distinct()
        out = out.join(allowed, "DeviceToken", "left")
    else:
        out = out.withColumn("allowed", F.lit(False))
    label, error = rules.decide(F.col("taxi"), F.col("bicycle"), F.coalesce("has", F.lit(False)), F.col("common"))
    out = out.withColumn("debug_pred", label).withColumn("__e", error)
    ok = F.col("error") == ""
    shown = rules.gate(F.col("debug_pred"), F.col("allowed"), F.col("CompanyId"))
    return out.select(
        "IncomingTrackId",
        F.col("Id").alias("RichTrackId"),
        F.when(ok, F.col("debug_pred")).alias("debug_pred"),
        F.when(ok, shown).alias("prediction"),
        F.when(ok, F.col("__e")).otherwise(F.col("error")).alias("error"),
    )


_KNOWN = {"tracks", "rich", "incoming"}


def check_upload(files: dict[str, str]) -> str:
    """An error text for a wrong set of uploaded files, '' for a right one."""
    if not files:
        return "no files"
    for key, name in files.items():
        if key not in _KNOWN:
            return f"unknown file {key}"
        if not name:
            return f"no name for {key}"
        if name.rsplit(".", 1)[-1].lower() not in ("zip", "gz", "csv"):
            return f"extension of {name} is not allowed"
    return ""
