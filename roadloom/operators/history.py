"""Operators over a device's timeline of trips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.geo import DEGREES_PER_METRE, haversine_m, planar


def timeline() -> Window:
    return Window.partitionBy("DeviceToken").orderBy("StartDate", "TrackId")


def neighbours(header: DataFrame) -> DataFrame:
    """Adds the ids of the device's previous and next trip."""
    return header.withColumn("prev_id", F.lag("TrackId").over(timeline())).withColumn("next_id", F.lead("TrackId").over(timeline()))


def latest_before(trips: DataFrame, history: DataFrame) -> DataFrame:
    """As-of join: each trip with the device's trips that ended last, not after its start; ties all stay.

    One union of starts and ends, ordered by time, finds the last end by a running maximum in a
    single exchange by device; no trip is paired with all of its history.
    """
    ends = history.select("DeviceToken", F.col("EndDate").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("TrackId"))
    starts = trips.select("DeviceToken", F.col("StartDate").alias("at"), F.lit(1).alias("kind"), F.col("TrackId").cast("long"))
    w = Window.partitionBy("DeviceToken").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = ends.unionByName(starts).withColumn("prev_end", F.max(F.when(F.col("kind") == 0, F.col("at"))).over(w))
    found = both.where("kind = 1 and prev_end is not null").select("DeviceToken", "TrackId", "prev_end")
    last = history.select("DeviceToken", F.col("EndDate").alias("prev_end"), F.col("TrackId").alias("prev_id"))
    return found.join(last, ["DeviceToken", "prev_end"])


def first_last_points(points: DataFrame) -> DataFrame:
    """Per trip, the first and last point by time; a pair of aggregates, no sort."""
    at = F.struct("PointDate", "RowId")
    cols = ["PointDate", "Latitude", "Longitude"]
    return points.groupBy("TrackId").agg(
        F.min("DeviceToken").alias("DeviceToken"), *(F.min_by(c, at).alias(f"first_{c}") for c in cols), *(F.max_by(c, at).alias(f"last_{c}") for c in cols)
    )


def distance_from_last(points: DataFrame) -> DataFrame:
    """Metres from the end of the device's trip before to the start of this one.

    A device's first trip gets the median of the others, an only trip 0.
    """
    ends = first_last_points(points)
    w = Window.partitionBy("DeviceToken").orderBy("first_PointDate", "TrackId")
    gap = haversine_m(F.lag("last_Latitude").over(w), F.lag("last_Longitude").over(w), F.col("first_Latitude"), F.col("first_Longitude"))
    ends = ends.withColumn("gap", gap)
    typical = ends.groupBy("DeviceToken").agg(F.median("gap").alias("typical"))
    return ends.join(typical, "DeviceToken").select("DeviceToken", "TrackId", F.coalesce("gap", "typical", F.lit(0.0)).alias("dist_from_last_track"))


END_RADII = [100, 100_000, 500, 1000]


#: Cells in which ends are counted, across a radius.
FINE = 32


def end_counts(points: DataFrame, metre: float = DEGREES_PER_METRE) -> DataFrame:
    """For each trip's end, the share of the other trips' ends within some radii, and ratios of those.

    Ends are counted by place, and places by small cells. Pairs of cells come from a join of squares of
    the radius with their neighbours. A cell that lies within the radius of all of another adds its
    count as one number, and only for cells across the rim are places compared, so a city full of ends
    isn't paired with itself.
    """
    ends = first_last_points(points).select("TrackId", F.col("last_Longitude").alias("x"), F.col("last_Latitude").alias("y"))
    radius = F.explode(F.array(*(F.lit(r) for r in END_RADII)))
    places = ends.groupBy("x", "y").agg(F.count("*").alias("k")).withColumn("r", radius)
    size = F.col("r") * F.lit(metre)
    places = places.select("r", "x", "y", "k", F.floor(F.col("x") / (size / FINE)).cast("long").alias("fx"), F.floor(F.col("y") / (size / FINE)).cast("long").alias("fy"))
    cells = places.groupBy("r", "fx", "fy").agg(F.sum("k").alias("k"))
    square = lambda c: F.floor(F.col(c) / FINE).cast("long")
    near = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = cells.select("r", "fx", "fy", square("fx").alias("cx"), square("fy").alias("cy"))
    b = cells.select("r", F.col("fx").alias("gx"), F.col("fy").alias("gy"), "k", F.explode(near).alias("by"))
    b = b.select("r", "gx", "gy", "k", (square("gx") + F.col("by.i")).alias("cx"), (square("gy") + F.col("by.j")).alias("cy"))
    dx, dy = F.abs(F.col("fx") - F.col("gx")), F.abs(F.col("fy") - F.col("gy"))
    reach = lambda x, y: F.sqrt(F.pow(x, 2) + F.pow(y, 2))
    most, least = reach(dx + 1, dy + 1), reach(F.greatest(dx - 1, F.lit(0)), F.greatest(dy - 1, F.lit(0)))
    pairs = a.join(b, ["r", "cx", "cy"]).select("r", "fx", "fy", "gx", "gy", "k", (most < FINE * (1 - 1e-9)).alias("whole")).where((least <= FINE) | F.col("whole"))
    whole = pairs.where("whole").groupBy("r", "fx", "fy").agg(F.sum("k").alias("whole"))
    other = places.select("r", F.col("fx").alias("gx"), F.col("fy").alias("gy"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("k").alias("k2"))
    rim = pairs.where("not whole").drop("k", "whole").join(places.drop("k"), ["r", "fx", "fy"]).join(other, ["r", "gx", "gy"])
    rim = rim.where(planar(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")) < size).groupBy("r", "x", "y").agg(F.sum("k2").alias("rim"))
    counts = places.join(whole, ["r", "fx", "fy"], "left").join(rim, ["r", "x", "y"], "left")
    n = F.coalesce("whole", F.lit(0)) + F.coalesce("rim", F.lit(0))
    wide = counts.groupBy("x", "y").agg(*(F.max(F.when(F.col("r") == r, n)).alias(f"n_{r}") for r in END_RADII))
    total = ends.count()
    share = {r: (F.col(f"n_{r}") - 1) / F.lit(total) for r in END_RADII}
    cols = [share[r].alias(f"rel_end_count_{r}") for r in END_RADII]
    cols += [(share[100] / F.when(share[r] <= 0, F.lit(1.0)).otherwise(share[r])).alias(f"end_count_100/{r}") for r in (500, 1000)]
    return ends.join(wide, ["x", "y"]).select("TrackId", *cols)


def balanced(df: DataFrame, label: str, order: list[str], parts: int = 200) -> DataFrame:
    """Each class cut to the size of the smallest one, in the given order; the first order column is a number.

    The order column is cut at approximate quantiles of each class. Ranges that lie wholly below the cut
    stay without being sorted; rows are numbered in the one range of each class that the cut falls in.
    """
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    key = F.col(order[0])
    marks = F.percentile_approx(key, [i / parts for i in range(1, parts)], 10_000)
    ends = df.groupBy(F.col(label).alias("__class")).agg(F.coalesce(marks, F.array().cast(f"array<{dict(df.dtypes)[order[0]]}>")).alias("__marks"))
    at = F.coalesce(F.size(F.filter("__marks", lambda m: m < key)), F.lit(-1))  # null keys come first
    cut = df.join(F.broadcast(ends), F.col(label).eqNullSafe(F.col("__class"))).withColumn("__at", at).drop("__marks")
    held = cut.groupBy("__class", "__at").agg(F.count("*").alias("__k"))
    before = F.sum("__k").over(Window.partitionBy("__class").orderBy("__at")) - F.col("__k")
    held = held.withColumn("__left", F.lit(least) - before).where("__left > 0").select(F.col("__class").alias("__c"), F.col("__at").alias("__a"), "__left", (F.col("__left") >= F.col("__k")).alias("__all"))
    kept = cut.join(F.broadcast(held), F.col("__class").eqNullSafe(F.col("__c")) & (F.col("__at") == F.col("__a"))).select(*df.columns, "__c", "__left", "__all")
    number = F.row_number().over(Window.partitionBy("__c").orderBy(*order))
    some = kept.where("not __all").withColumn("__n", number).where("__n <= __left")
    return kept.where("__all").select(*df.columns).unionByName(some.select(*df.columns))
