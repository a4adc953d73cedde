"""Decision rules as nested conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import cell, haversine_m
from roadloom.functions.stats import ratio, seconds
from roadloom.operators.prep import deduplicate
from roadloom.schema import AIRPORT, BIG_GAP, NEAR_AIRPORT, NOT_AIRPORT, SMALL_GAP, VERY_BIG_GAP
from roadloom.session import materialised

# Distances in metres and times in seconds that divide the classes.
AIRPORT_M, NEAR_M, FAR_M, CLOSE_M = 1500.0, 3500.0, 400_000.0, 100_000.0
DAY_S = 86_400.0
MODEL_THRESHOLD, RAIL_THRESHOLD, SHORTEST_KM, SLOW_KMH = 0.4, 0.8, 2.0, 25.0
DEBUG_COMPANIES = [6, 1064]


def nearest_airport(points: DataFrame, airports: DataFrame, lat: str, lon: str, keys: list[str]) -> DataFrame:
    """Metres to the nearest airport within NEAR_M, else null.

    Both sides meet on grid cells of a latitude band a little higher than NEAR_M. A cell is as wide
    in longitude as NEAR_M is at its latitude's far side, so neighbouring cells always suffice.
    """
    band = 0.05
    widths = F.greatest(F.cos(F.radians((F.abs(F.col("__b")) + 2) * band)), F.lit(0.01))
    p = points.select(*keys, F.col(lat).alias("__la"), F.col(lon).alias("__lo"))
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    p = p.withColumn("__by", F.explode(near)).withColumn("__b", cell(F.col("__la"), band) + F.col("__by.i"))
    p = p.withColumn("__c", F.floor(F.col("__lo") / (F.lit(band) / widths)).cast("long") + F.col("__by.j"))
    a = airports.select(F.col("latitude").alias("__ala"), F.col("longitude").alias("__alo")).withColumn("__b", cell(F.col("__ala"), band))
    a = a.withColumn("__c", F.floor(F.col("__alo") / (F.lit(band) / widths)).cast("long"))
    d = haversine_m(F.col("__la"), F.col("__lo"), F.col("__ala"), F.col("__alo"))
    found = p.join(a, ["__b", "__c"]).groupBy(*keys).agg(F.min(d).alias("airport_m"))
    return points.join(found.where(F.col("airport_m") <= NEAR_M), keys, "left")


def airport_class(metres: Column) -> Column:
    return F.when(metres <= AIRPORT_M, AIRPORT).when(metres <= NEAR_M, NEAR_AIRPORT).otherwise(NOT_AIRPORT)


def nearer_only(start_m: Column, end_m: Column) -> tuple[Column, Column]:
    """Classes of both ends; if both are near an airport only the nearer one counts, at a tie the end."""
    both = F.coalesce(F.greatest(start_m, end_m) <= NEAR_M, F.lit(False)) & start_m.isNotNull() & end_m.isNotNull()
    start = F.when(both & (start_m >= end_m), NOT_AIRPORT).otherwise(airport_class(start_m))
    end = F.when(both & (start_m < end_m), NOT_AIRPORT).otherwise(airport_class(end_m))
    return start, end


def gap_class(secs: Column) -> Column:
    return F.when(secs > 5 * DAY_S, VERY_BIG_GAP).when(secs > 2 * DAY_S, BIG_GAP).otherwise(SMALL_GAP)


def is_far(lat1, lon1, lat2, lon2, fix_axes: bool = False) -> Column:
    """Whether two points are 400 km apart; the axes are exchanged unless fix_axes is set."""
    return (haversine_m(lat1, lon1, lat2, lon2) if fix_axes else haversine_m(lon1, lat1, lon2, lat2)) >= FAR_M


def start_end(points: DataFrame) -> DataFrame:
    """First and last moment of each trip, the means of its first and last three points, and its first point."""
    up = Window.partitionBy("TrackId").orderBy("PointDate", "RowId")
    down = Window.partitionBy("TrackId").orderBy(F.col("PointDate").desc(), F.col("RowId").desc())
    df = points.withColumn("__u", F.row_number().over(up)).withColumn("__d", F.row_number().over(down))
    head, tail = F.col("__u") <= 3, F.col("__d") <= 3
    return df.groupBy("TrackId").agg(
        F.min("DeviceToken").alias("DeviceToken"),
        F.min("PointDate").alias("start_date"),
        F.max("PointDate").alias("end_date"),
        F.avg(F.when(head, F.col("Latitude"))).alias("start_lat"),
        F.avg(F.when(head, F.col("Longitude"))).alias("start_lon"),
        F.avg(F.when(tail, F.col("Latitude"))).alias("end_lat"),
        F.avg(F.when(tail, F.col("Longitude"))).alias("end_lon"),
        F.max(F.when(F.col("__u") == 1, F.col("Latitude"))).alias("first_lat"),
        F.max(F.when(F.col("__u") == 1, F.col("Longitude"))).alias("first_lon"),
        F.avg("Latitude").alias("avg_lat"),
        F.avg("Longitude").alias("avg_lon"),
        F.count("*").alias("n_points"),
    )


def homes(trips: DataFrame) -> DataFrame:
    """Per device, the medians of its trips' mean coordinates, rounded to a tenth of a degree."""
    return trips.groupBy("DeviceToken").agg(F.median(F.bround("avg_lat", 1)).alias("home_lat"), F.median(F.bround("avg_lon", 1)).alias("home_lon"))


def airport_taxi(points: DataFrame, airports: DataFrame, labels: DataFrame | None = None, fix_time_sign: bool = False, fix_axes: bool = False, old: bool = False) -> DataFrame:
    """(TrackId, taxi): 1 a taxi from or to an airport, 0 the driver, -1 something else.

    The device's trip before the start, or after the end, decides. By default the sign of the time
    between trips, the axes of the far distance and the ends compared after a trip to an airport are
    as in the original rule; the flags give the evident meaning. labels (TrackId, prediction) are
    earlier predictions; a trip without one counts as the driver's. A trip that is the device's first
    and away from home and airports is -1. old: the earlier variant of the rule, in which trips of
    fewer than ten points are the driver's and a trip to an airport is compared with the next start.
    """
    ends = materialised(start_end(deduplicate(points)))  # a row a trip, read by all that follows
    trips = materialised(ends.join(homes(ends), "DeviceToken"))
    for side in ("start", "end"):
        found = nearest_airport(trips.select("TrackId", f"{side}_lat", f"{side}_lon"), airports, f"{side}_lat", f"{side}_lon", ["TrackId"])
        trips = trips.join(found.select("TrackId", F.col("airport_m").alias(f"{side}_m")), "TrackId")
    s, e = nearer_only(F.col("start_m"), F.col("end_m"))
    trips = trips.withColumn("S", s).withColumn("E", e)
    if labels is None:
        trips = trips.withColumn("label", F.lit("OriginalDriver"))
    else:
        trips = trips.join(labels.select("TrackId", F.coalesce("prediction", F.lit("OriginalDriver")).alias("label")), "TrackId", "left").fillna("OriginalDriver", ["label"])
    away = lambda la, lo: haversine_m(la, lo, F.col("home_lat"), F.col("home_lon")) >= FAR_M
    trips = trips.withColumn("H", ~away(F.col("first_lat"), F.col("first_lon"))).withColumn("end_away", away(F.col("end_lat"), F.col("end_lon")))
    w = Window.partitionBy("DeviceToken").orderBy("start_date", "TrackId")
    kept = F.struct("start_date", "end_date", "start_lat", "start_lon", "end_lat", "end_lon", "end_away", "label")
    trips = trips.withColumn("p", F.lag(kept).over(w)).withColumn("q", F.lead(kept).over(w))
    from_start = F.col("S") != NOT_AIRPORT
    other = F.when(from_start, F.col("p")).otherwise(F.col("q"))
    reach = F.when(from_start, F.col("S")).otherwise(F.col("E"))
    if old:
        from_start = from_start & F.col("p").isNotNull()
        other, reach = F.when(from_start, F.col("p")).when(F.col("E") != NOT_AIRPORT, F.col("q")), F.when(from_start, F.col("S")).otherwise(F.col("E"))
    # which two ends are compared: the other trip's end with this start, or this end with the other's start
    ahead = from_start if old or fix_time_sign else F.lit(True)
    pick = lambda a, b: F.when(ahead, a).otherwise(b)
    here, there = pick(other["end_lat"], F.col("end_lat")), pick(F.col("start_lat"), other["start_lat"])
    here_lon, there_lon = pick(other["end_lon"], F.col("end_lon")), pick(F.col("start_lon"), other["start_lon"])
    first, second = pick(other["end_date"], F.col("end_date")), pick(F.col("start_date"), other["start_date"])
    secs = seconds(second, first) if fix_time_sign else seconds(first, second)
    gap = gap_class(secs)
    home = F.when(F.col("H"), 0).otherwise(-1)
    decided = (
        F.when(is_far(here, here_lon, there, there_lon, fix_axes), 1)
        .when(gap == SMALL_GAP, home)
        .when(((reach == AIRPORT) & (gap == BIG_GAP)) | ((reach == NEAR_AIRPORT) & (gap == VERY_BIG_GAP)), 1)
        .otherwise(-1)
    )
    alone = F.when((F.col("S") == AIRPORT) | (F.col("E") == AIRPORT), -1).otherwise(0)
    nowhere = (F.col("S") == NOT_AIRPORT) & (F.col("E") == NOT_AIRPORT)
    if old:
        taxi = F.when(F.col("n_points") < 10, 0).when(nowhere, home).when(other.isNull(), alone).otherwise(decided)
    else:
        near_before = haversine_m(F.col("first_lat"), F.col("first_lon"), F.col("p.end_lat"), F.col("p.end_lon")) < CLOSE_M
        abroad = F.when(F.col("p").isNotNull() & F.col("p.end_away") & (F.col("p.label") == "OriginalDriver") & near_before, 0).otherwise(-1)
        single = F.when(reach == AIRPORT, -1).otherwise(0)
        taxi = F.when(nowhere & F.col("H"), 0).when(nowhere, abroad).when(other.isNull(), single).otherwise(decided)
    return trips.select("TrackId", taxi.alias("taxi"))


def bicycle(points: DataFrame) -> DataFrame:
    """(TrackId, bicycle): shaken all the time, never fast, and long enough."""
    axes = ["GyroscopeXOriginal", "GyroscopeYOriginal", "GyroscopeZOriginal"]
    if any(a not in points.columns for a in axes):
        return points.select("TrackId").distinct().withColumn("bicycle", F.lit(False))
    df = deduplicate(points)
    down = Window.partitionBy("TrackId").orderBy(F.col("PointDate").desc(), F.col("RowId").desc())
    turn = F.coalesce(F.sqrt(sum((F.pow(F.col(a), 2) for a in axes), F.lit(0.0))), F.lit(0.0))
    df = df.withColumn("__body", F.row_number().over(down) > 100).withColumn("__turn", turn)
    body = F.sum(F.col("__body").cast("int"))
    share = ratio(F.sum((F.col("__body") & (F.col("__turn") > 1)).cast("int")), body)
    secs = seconds(F.max("PointDate"), F.min("PointDate"))
    top = F.max("Speed")
    rule = (body > 0) & (share > 0.15) & (top > 10) & (top < 30) & (secs / 60 > 5) & (F.count("*") > 100)
    return df.groupBy("TrackId").agg(F.coalesce(rule, F.lit(False)).alias("bicycle"))


def transport(speed_max: Column, proba: Column, distance_km: Column, rail_share: Column) -> Column:
    """Other below 25 km/h; else a train by its rails, else a bus by the model, else the driver."""
    far = distance_km > SHORTEST_KM
    return (
        F.when(speed_max < SLOW_KMH, "Other")
        .when(F.coalesce((rail_share >= RAIL_THRESHOLD) & far, F.lit(False)), "Train")
        .when(F.coalesce((proba >= MODEL_THRESHOLD) & far, F.lit(False)), "Bus")
        .otherwise("OriginalDriver")
    )


def decide(taxi: Column, bike: Column, has_features: Column, common: Column) -> tuple[Column, Column]:
    """(label, error): bicycle before airport before the common rule; a rule without features is an error."""
    rule = F.when(F.coalesce(bike, F.lit(False)), "Bicycle").when(taxi == 1, "Taxi").when(taxi == -1, "Other")
    label = F.when(rule.isNull(), F.when(has_features, common).otherwise("OriginalDriver")).when(has_features, rule)
    return label, F.when(rule.isNotNull() & ~has_features, "track is empty").otherwise("")


def gate(label: Column, allowed: Column, company: Column) -> Column:
    """What leaves the engine: the label for allowed devices and some companies, else the driver."""
    shown = F.coalesce(company.isin(DEBUG_COMPANIES) & ~label.eqNullSafe("Bicycle"), F.lit(False))
    return F.when(F.coalesce(allowed, F.lit(False)) | shown, label).otherwise("OriginalDriver")
