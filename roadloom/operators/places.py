"""Personal places: dense trip ends of a device, marked as home, work or weekend place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions import kernels
from roadloom.functions.geo import on_sphere
from roadloom.operators import density


def end_clusters(ends: DataFrame, metres: float = 1000.0, others: int = 3) -> DataFrame:
    """Adds label: clusters of ends with enough others strictly within the radius; -1 for the rest.

    ends: (DeviceToken, PointDate, Latitude, Longitude).
    """
    return density.labelled(ends, "DeviceToken", ["PointDate", "Latitude", "Longitude"], on_sphere("Latitude", "Longitude"), kernels.chord(metres), others + 1, True, "label")


def cluster_stats(labelled: DataFrame) -> DataFrame:
    """Per cluster: ends on weekends and workdays, median hour and place."""
    weekend = F.weekday("PointDate") >= 5
    return (
        labelled.where("label <> -1")
        .groupBy("DeviceToken", "label")
        .agg(
            F.sum(weekend.cast("int")).alias("holy_num"),
            F.sum((~weekend).cast("int")).alias("work_num"),
            F.median(F.hour("PointDate")).alias("median_hour"),
            F.median("Longitude").alias("Longitude"),
            F.median("Latitude").alias("Latitude"),
        )
    )


def annotate(stats: DataFrame) -> DataFrame:
    """Adds place: the most visited cluster is home, the one with most workday ends of the others work,
    others with more weekend than workday ends holy. The lower label wins a tie."""
    w = Window.partitionBy("DeviceToken")
    visits = F.col("holy_num") + F.col("work_num")
    df = stats.withColumn("__home", F.row_number().over(w.orderBy(visits.desc(), "label")) == 1)
    df = df.withColumn("__work", ~F.col("__home") & (F.row_number().over(w.orderBy("__home", F.col("work_num").desc(), "label")) == 1))
    place = F.when(F.col("__home"), "home").when(F.col("__work"), "work").when(F.col("holy_num") > F.col("work_num"), "holy").otherwise("")
    return df.withColumn("place", place).drop("__home", "__work")


def places(ends: DataFrame, metres: float = 1000.0) -> DataFrame:
    """Annotated places; devices without a dense place have no row."""
    return annotate(cluster_stats(end_clusters(ends, metres)))
