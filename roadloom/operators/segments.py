"""Runs of a threshold state in a trip: the car and walking parts, stops and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadloom.functions.stats import seconds
from roadloom.operators.prep import by_trip, in_order

WALK_SPEED, STAND_SPEED, SHORTEST_S = 9.0, 3.0, 5.0


def state_edge(slow: Column) -> Column:
    """+1 where a slow run begins, -1 where it gives way to a fast one, 0 elsewhere; the first row begins a run."""
    now = F.coalesce(slow, F.lit(False))
    before = F.lag(now.cast("int")).over(in_order())
    return F.when(before.isNull(), F.when(now, 1).otherwise(-1)).otherwise(now.cast("int") - before)


def run_id(edge: Column) -> Column:
    """Number of the run a row belongs to, from 1."""
    return F.sum((edge != 0).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0))


def split_walk(points: DataFrame, walk_speed: float = WALK_SPEED) -> DataFrame:
    """Adds n (position), is_car and is_walk; both parts include the row of the cut.

    The cut is the start of the last slow run if no fast run follows it, else the last row. A trip
    that is slow or fast throughout is all car, and its walking part is its last row.
    """
    df = points.withColumn("__e", state_edge(F.col("Speed") <= walk_speed)).withColumn("n", F.row_number().over(in_order()))
    w = by_trip()
    slow, fast = F.max(F.when(F.col("__e") == 1, F.col("n"))).over(w), F.max(F.when(F.col("__e") == -1, F.col("n"))).over(w)
    df = df.withColumn("cut", F.when(slow > fast, slow).otherwise(F.count("*").over(w)))
    return df.withColumn("is_car", F.col("n") <= F.col("cut")).withColumn("is_walk", F.col("n") >= F.col("cut")).drop("__e", "cut")


def intervals(points: DataFrame, stand_speed: float = STAND_SPEED) -> DataFrame:
    """Adds stop_s (a stop that ends at this row) and move_m (a move that ends here) to car rows.

    Both are measured between rows where the state changes; intervals up to five seconds don't count.
    points: with is_car. A trip's open interval at its end isn't measured.
    """
    edge = state_edge(F.col("Speed") <= stand_speed)
    df = points.withColumn("__e", F.when(F.col("is_car"), edge).otherwise(0))
    before = in_order().rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(F.col("__e") != 0, F.struct("PointDate", "TotalMeters"))
    df = df.withColumn("__p", F.last(mark, ignorenulls=True).over(before))
    gap = seconds(F.col("PointDate"), F.col("__p.PointDate"))
    counts = (F.col("__e") != 0) & (gap > SHORTEST_S)
    df = df.withColumn("stop_s", F.when(counts & (F.col("__e") == -1), gap))
    return df.withColumn("move_m", F.when(counts & (F.col("__e") == 1), F.col("TotalMeters") - F.col("__p.TotalMeters"))).drop("__e", "__p")


def longest_run(df: DataFrame, good: Column, order: list[str]) -> DataFrame:
    """Per trip, the longest run of good rows that a bad row ends; a run open at the end doesn't count."""
    w = by_trip().orderBy(*order)
    df = df.withColumn("__g", F.coalesce(good, F.lit(False)))
    bad_after = F.sum((~F.col("__g")).cast("int")).over(w.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("__r", bad_after)
    runs = df.groupBy("TrackId", "__r").agg(F.sum(F.col("__g").cast("int")).alias("len"))
    return runs.groupBy("TrackId").agg(F.coalesce(F.max(F.when(F.col("__r") > 0, F.col("len"))), F.lit(0)).alias("longest_run"))
