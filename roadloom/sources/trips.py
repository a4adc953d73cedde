"""Sources: CSV files, parameterised SQL, keyed frames, logs, and the adapter from an event table."""

from __future__ import annotations

import io
import re
import zipfile
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom import schema


class Trips(NamedTuple):
    tracks: DataFrame
    rich: DataFrame
    incoming: DataFrame


def read_csv(spark: SparkSession, path: str | list[str], schema_: str, columns: list[str] | None = None, sep: str = ",", decimal: str = ".") -> DataFrame:
    """CSV with a header, compressed or not; '' and NA are null, whatever the column's type.

    Columns are matched by name; those of the schema that a file lacks come back as null. decimal
    is the decimal sign of numbers. Integers are exact; text that isn't a whole number of the column's
    range is null.
    """
    return _typed(spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path), schema_, columns, decimal)


def _typed(raw: DataFrame, schema_: str, columns: list[str] | None, decimal: str) -> DataFrame:
    """Text columns as those of the schema."""
    wanted = T._parse_datatype_string(schema_)
    there = {c.lower(): c for c in raw.columns}
    out = []
    for f in wanted.fields:
        if columns is not None and f.name not in columns:
            continue
        if f.name.lower() not in there:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        text = F.trim(F.col(f"`{there[f.name.lower()]}`"))
        text = F.when(~text.isin("", "NA"), text)
        if decimal != "." and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            text = F.replace(text, F.lit(decimal), F.lit("."))
        value = text.try_cast(f.dataType)
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):  # whole numbers with decimals, as 7.0, too; never by way of a double
            exact = text.try_cast("decimal(38,18)")
            value = F.coalesce(value, F.when(exact == F.floor(exact), exact).try_cast(f.dataType))
        out.append(value.alias(f.name))
    return raw.select(*out)


def read_zip(spark: SparkSession, path: str, schema_: str, sep: str = ",", decimal: str = ".") -> DataFrame:
    """CSV files inside zip archives, read as ``read_csv`` reads plain ones.

    An archive is one upload: a task unpacks it whole. All members are tables of the same columns, and
    their lines are records (no line breaks inside quotes).
    """

    def unpack(batches):
        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        lines = z.read(member).decode("utf-8-sig").splitlines()
                        yield pd.DataFrame({"head": [lines[0]] * (len(lines) - 1), "line": lines[1:]}) if lines else pd.DataFrame({"head": [], "line": []})

    lines = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "head string, line string")
    heads = [r["head"] for r in lines.select("head").distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError("the files of the archives have different columns")
    names = [n.strip().strip('"') for n in heads[0].split(sep)] if heads else []
    raw = ", ".join(f"`{n}` string" for n in names) or "none string"
    parsed = lines.select(F.from_csv("line", F.lit(raw), {"sep": sep}).alias("r")).select("r.*")
    return _typed(parsed, schema_, None, decimal)


def load(spark: SparkSession, tracks: str, rich: str, incoming: str) -> Trips:
    """The three tables of a set of trips."""
    return Trips(read_csv(spark, tracks, schema.TRACKS), read_csv(spark, rich, schema.RICH_POINTS), read_csv(spark, incoming, schema.INCOMING_POINTS))


def natural_key(text: str) -> list:
    """Sort key in which runs of digits, with their sign, compare as numbers."""
    parts = re.split(r"([+-]?\d+)", text)
    return [(0, int(p), "") if re.fullmatch(r"[+-]?\d+", p) else (1, 0, p) for p in parts]


def trip_files(paths: list[str], names: tuple[str, str, str]) -> list[tuple[str, str, str]]:
    """Triples of files of one trip, matched by the number in their name, in natural order."""
    by: dict[str, dict[str, str]] = {}
    for p in paths:
        base = p.rsplit("/", 1)[-1]
        for n in names:
            m = re.fullmatch(rf"(\d+)_{re.escape(n)}\..*", base)
            if m:
                by.setdefault(m[1], {})[n] = p
    return [tuple(by[k][n] for n in names) for k in sorted(by, key=natural_key) if len(by[k]) == 3]


def query(spark: SparkSession, text: str, tables: dict[str, DataFrame], **args) -> DataFrame:
    """SQL with named parameters over the given tables."""
    return spark.sql(text, args=args or None, **tables)


def read_jdbc(spark: SparkSession, url: str, sql: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database query read in parallel ranges of a numeric key."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", f"({sql}) as q")
    r = r.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).option("fetchsize", 20_000)
    return r.options(**options).load()


def fetch(frames: DataFrame, token, ids: list, tag: str | None = None) -> DataFrame:
    """Rows of one device and some trips; unknown ids give nothing."""
    out = frames.where((F.col("DeviceToken") == F.lit(token)) & F.col("TrackId").isin(ids))
    return out.where(F.col("Tag") == tag) if tag else out


def list_slice(frames: DataFrame, by: list[str], order: list[str], first: int, last: int) -> DataFrame:
    """Elements first..last (both included, from 0; -1 is the last one) of each list in its order."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    at = F.row_number().over(w.orderBy(*order)) - 1
    lo = F.lit(first) if first >= 0 else n + first
    hi = F.lit(last) if last >= 0 else n + last
    keyed = frames.withColumn("__at", at).withColumn("__lo", lo).withColumn("__hi", hi)
    return keyed.where(F.col("__at").between(F.col("__lo"), F.col("__hi"))).drop("__at", "__lo", "__hi")


def without_indexes(frames: DataFrame, by: list[str], order: list[str], indexes: list[int]) -> DataFrame:
    """The list without the elements at the given positions."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return frames.withColumn("__at", at).where(~F.col("__at").isin(indexes)).drop("__at")


def keys_like(keys: DataFrame, pattern: str, column: str = "key") -> DataFrame:
    """Distinct first parts of the colon-separated keys that match a LIKE pattern."""
    return keys.where(F.col(column).like(pattern)).select(F.split(column, ":")[0].alias("token")).distinct()


def exactly_one(text: Column, pattern: str) -> Column:
    """The only match of a pattern in a line; null if there is none or more than one."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def scan_log(lines: DataFrame, fields: dict[str, str], column: str = "value") -> DataFrame:
    """One column per pattern; lines in which any of them isn't found exactly once go."""
    return lines.select(*(exactly_one(F.col(column), p).alias(n) for n, p in fields.items())).dropna()


def track_points(events: DataFrame) -> DataFrame:
    """Trip points made of an event table: a trip is a user's ten days of a month."""
    dec = F.floor((F.dayofmonth("ts") - 1) / 10.0).cast("long")
    order = Window.partitionBy("user_id", "__dec").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    lat = F.lit(55.0) + (F.col("event_id") * 7919 % 41) * F.lit(0.0001) + (F.col("user_id") % 10) * F.lit(0.005)
    lat = lat + F.when((F.col("user_id") % 7 == 0) & (F.col("__dec") == 2), 5).otherwise(0)
    lon = F.lit(37.0) + (F.col("event_id") * 104729 % 43) * F.lit(0.0001)
    return events.withColumn("__dec", dec).select(
        F.col("event_id").alias("RowId"),
        F.col("user_id").alias("DeviceToken"),
        (F.col("user_id") * 10 + F.col("__dec")).alias("TrackId"),
        F.col("ts").alias("PointDate"),
        F.col("value").alias("Speed"),
        F.round(F.sum("value").over(order), 6).alias("TotalMeters"),
        F.get_json_object("props", "$.k").cast("double").alias("SpeedLimit"),
        F.round(lat, 6).alias("Latitude"),
        F.round(lon, 6).alias("Longitude"),
    )


def track_header(points: DataFrame) -> DataFrame:
    """One row per trip: its device, first and last time, length and number of points."""
    return points.groupBy("TrackId").agg(
        F.min("DeviceToken").alias("DeviceToken"),
        F.min("PointDate").alias("StartDate"),
        F.max("PointDate").alias("EndDate"),
        F.max("TotalMeters").alias("Distance"),
        F.count("*").alias("n_points"),
    )
