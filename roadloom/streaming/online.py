"""Online scoring with the batch plan, and stateful streams over trip points."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def watch(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def score_stream(points: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, also: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> StreamingQuery:
    """Runs the batch plan on each micro-batch of whole trips and writes it once.

    A batch goes to a folder of its own number, overwritten if it is run again after a failure. also:
    further sinks by folder, each with what it gets of the plan's result, which is computed once. The
    plan may join static tables; they are read as usual, or broadcast by Spark where they are small.
    """

    def write(batch: DataFrame, number: int) -> None:
        result = plan(batch)
        if also:
            result = result.persist()
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")
        for folder, part in (also or {}).items():
            part(result).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if also:
            result.unpersist()

    return points.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_trip_per_device(headers: DataFrame) -> DataFrame:
    """A stream of headers (DeviceToken, TrackId, EndDate) into each device's latest trip so far.

    State is one pair per device; ties on the time go to the larger id.
    """

    def update(key: tuple, batches, state: GroupState):
        best = state.get if state.exists else (None, None)
        for g in batches:
            for at, trip in zip(g["EndDate"], g["TrackId"], strict=True):
                now = (int(pd.Timestamp(at).value // 1000), int(trip))
                if best[0] is None or now > tuple(best):
                    best = now
        state.update(tuple(best))
        yield pd.DataFrame({"DeviceToken": [key[0]], "TrackId": [best[1]], "end_us": [best[0]]})

    kind = dict(headers.dtypes)["DeviceToken"]
    return headers.groupBy("DeviceToken").applyInPandasWithState(update, f"DeviceToken {kind}, TrackId bigint, end_us bigint", "end_us bigint, TrackId bigint", "update", GroupStateTimeout.NoTimeout)


def sessions(points: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Trips cut by gaps in a device's points; closed once the watermark has passed them."""
    df = points.withColumn("at", F.col("PointDate").cast("timestamp"))
    if points.isStreaming:
        df = df.withWatermark("at", late)
    out = df.groupBy("DeviceToken", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n"), F.max("Speed").alias("speed_max"))
    return out.select("DeviceToken", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "speed_max")


def windowed_speed(points: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Mean and largest speed per device and time window."""
    df = points.withColumn("at", F.col("PointDate").cast("timestamp"))
    if points.isStreaming:
        df = df.withWatermark("at", late)
    w = F.window("at", size, slide) if slide else F.window("at", size)
    out = df.groupBy("DeviceToken", w.alias("w")).agg(F.count("*").alias("n"), F.mean("Speed").alias("speed_mean"), F.max("Speed").alias("speed_max"))
    return out.select("DeviceToken", F.col("w.start").alias("start"), "n", "speed_mean", "speed_max")


def unique_points(points: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Points without repeats inside the watermark."""
    df = points.withColumn("at", F.col("PointDate").cast("timestamp"))
    return df.withWatermark("at", late).dropDuplicatesWithinWatermark(keys) if points.isStreaming else df.dropDuplicates(keys)
