"""Uploads that come as three files, put together from a stream and scored once when they are complete.

The stream is one of file names: state per upload holds the paths of the parts that have come, never their
rows. A part is a whole file, so an upload is complete when all kinds have come, in whichever batches; its
files are then read and scored by the batch plan, many uploads together. An upload that stays incomplete
until the watermark of the files' times has passed its wait goes to the error sink, and so do files of
unknown kinds, parts of an upload that is already scored, and parts that come after their upload has expired.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadloom import schema
from roadloom.sources.trips import read_csv

#: Kinds of parts with the columns of their files.
KINDS = {"tracks": schema.TRACKS, "rich": schema.RICH_POINTS, "incoming": schema.INCOMING_POINTS}
#: Name and kind in a path such as in/17_rich.csv.gz.
PATTERN = r"([^/]+)_([a-z]+)\.(?:csv|csv\.gz|gz)$"
_OUT = "upload string, status string, files string, error string"


def parts(spark: SparkSession, folder: str, pattern: str = PATTERN, files_per_batch: int = 300) -> DataFrame:
    """A stream (upload, kind, path, at) of the files of a folder; their contents are not read. Spark passes over empty files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(folder)
    name = lambda group: F.regexp_extract("path", pattern, group)
    upload = F.when(name(1) == "", F.col("path")).otherwise(name(1))
    return files.select(upload.alias("upload"), name(2).alias("kind"), "path", F.col("modificationTime").alias("at"))


def assembled(files: DataFrame, kinds: tuple[str, ...] = tuple(KINDS), wait: str = "1 hour", late: str = "0 seconds") -> DataFrame:
    """(upload, status, files, error) of files (upload, kind, path, at): complete once, or what is wrong with an upload.

    files is JSON by kind. A part that comes again before its upload is complete takes the place of the
    first. wait: from an upload's latest part on. late: how far files may be out of the order of their times.
    """
    patience = int(pd.Timedelta(wait).total_seconds() * 1000)

    def row(upload: str, status: str, have: dict, error: str = "") -> pd.DataFrame:
        return pd.DataFrame([[upload, status, json.dumps(have, sort_keys=True), error]], columns=["upload", "status", "files", "error"])

    def update(key: tuple, batches, state: GroupState):
        (upload,) = key
        done, have = (state.get[0], json.loads(state.get[1])) if state.exists else (False, {})
        if state.hasTimedOut:
            if not done:
                yield row(upload, "incomplete", have, "missing: " + ", ".join(k for k in kinds if k not in have))
            state.remove()
            return
        latest, again, strange = 0, {}, {}
        rows = pd.concat(list(batches)).sort_values(["at", "path"])
        for kind, path, at in zip(rows["kind"], rows["path"], rows["at"], strict=True):
            latest = max(latest, int(pd.Timestamp(at).timestamp() * 1000))
            (strange if kind not in kinds else again if done else have)[kind] = path
        for kind, path in strange.items():
            yield row(upload, "unknown", {kind: path}, f"unknown file {kind or path.rsplit('/', 1)[-1]}")
        if again:
            yield row(upload, "repeated", again, "the upload has been scored: " + ", ".join(sorted(again)))
        elif not done and all(k in have for k in kinds):
            yield row(upload, "complete", have)
            done, have = True, {}
        if not (done or have):
            return  # strange files alone open no upload
        until = latest + patience
        if until <= state.getCurrentWatermarkMs():  # its time is over already
            if not done:
                yield row(upload, "incomplete", have, "too late, missing: " + ", ".join(k for k in kinds if k not in have))
            if state.exists:
                state.remove()
            return
        state.update((done, json.dumps(have)))
        state.setTimeoutTimestamp(until)

    keyed = files.withWatermark("at", late).groupBy("upload")
    return keyed.applyInPandasWithState(update, _OUT, "done boolean, files string", "append", GroupStateTimeout.EventTimeTimeout)


def score_uploads(
    uploads: DataFrame, plan: Callable[..., DataFrame], out: str, errors: str, checkpoint: str, kinds: dict[str, str] | None = None, read: Callable[[SparkSession, list[str], str], DataFrame] = read_csv
) -> StreamingQuery:
    """Scores each complete upload of ``assembled`` once; what is wrong with others goes to errors.

    plan gets the rows of each kind by name, those of all uploads that a batch completes. Both sinks
    are folders by batch number, written again if a batch runs again.
    """
    kinds = kinds or KINDS

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        spark = batch.sparkSession
        ready = [json.loads(r[0]) for r in batch.where("status = 'complete'").select("files").collect()]  # no more than a batch has files
        if ready:
            plan(**{k: read(spark, [f[k] for f in ready], s) for k, s in kinds.items()}).write.mode("overwrite").parquet(f"{out}/batch={number}")
        wrong = batch.where("status <> 'complete'")
        if not wrong.isEmpty():
            wrong.write.mode("overwrite").parquet(f"{errors}/batch={number}")
        batch.unpersist()

    return uploads.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
