"""A keyed table in hashed buckets: upserts rewrite the buckets they touch, readers see whole versions.

Layout of a store's folder:
  data/version=N/bucket=K   the rows of a bucket as version N wrote them
  versions/N                a row per bucket: which version its rows are of; once there, it never changes

A version becomes visible by one rename of its finished list, so a reader sees all of an upsert or nothing,
and of two writers of one version the second fails and leaves the store as it is. Buckets that no new
row falls into keep their files. Keys may be null; rows with one key in one upsert are the caller's to avoid
or to order (``latest``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the version first."""


class KeyedStore:
    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        at, fs = self._path("versions"), self._fs()
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at) if x.getPath().getName().isdigit()) if fs.exists(at) else []

    def _buckets(self, version: int) -> dict[int, int]:
        """By bucket the version of its rows; as many as there are buckets at most."""
        return {r["bucket"]: r["version"] for r in self.spark.read.parquet(f"{self.folder}/versions/{version}").collect()}

    def read(self, version: int | None = None, of_buckets: list[int] | None = None) -> DataFrame:
        """All rows of a version, the latest by default, or those of some buckets."""
        version = version or max(self.versions(), default=0)
        if not version:
            raise FileNotFoundError(f"{self.folder} has no version")
        parts = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(self._buckets(version).items()) if of_buckets is None or b in of_buckets]
        return self.spark.read.parquet(*parts) if parts else self.read(version).where("false")

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def upsert(self, rows: DataFrame, latest: list[str] | None = None, insert: bool = True) -> int:
        """Rows take the place of those with their keys; new keys are added unless ``insert`` is off. Returns the version.

        latest: columns whose largest values choose among rows with one key. rows: repeatable; its columns
        are those of the store. Columns missing in rows keep the old values.
        """
        before = max(self.versions(), default=0)
        now, have = before + 1, self._buckets(before) if before else {}
        if latest:
            w = Window.partitionBy(*self.keys).orderBy(*(F.col(c).desc() for c in latest))
            rows = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
        rows = rows.withColumn("bucket", self.bucket())
        touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # no more than there are buckets
        old = [b for b in touched if b in have]
        merged = rows if insert else rows.where("false")
        if old:
            merged = self._merged(rows, self.read(before, old).withColumn("bucket", self.bucket()), insert)
        if not touched:
            merged = rows
        stage = f"{self.folder}/data/version={now}"
        if self._fs().exists(self._path("data", f"version={now}")):
            self._fs().delete(self._path("data", f"version={now}"), True)  # of a writer that failed
        merged.repartition(max(1, len(touched)), "bucket").write.partitionBy("bucket").parquet(stage)
        wrote = [b for b in touched if self._fs().exists(self._path("data", f"version={now}", f"bucket={b}"))]
        return self._publish(now, {**have, **dict.fromkeys(wrote, now)})

    def _merged(self, rows: DataFrame, old: DataFrame, insert: bool) -> DataFrame:
        on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in ("bucket", *self.keys)]
        both = old.withColumn("__o", F.lit(True)).alias("o").join(rows.withColumn("__n", F.lit(True)).alias("n"), on, "full" if insert else "left")
        there = rows.columns
        pick = [F.when(F.col("__n"), F.col(f"n.`{c}`")).otherwise(F.col(f"o.`{c}`")).alias(c) if c in there else F.col(f"o.`{c}`").alias(c) for c in old.columns]
        return both.select(*pick)

    def _publish(self, version: int, buckets: dict[int, int]) -> int:
        draft = f"draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame(sorted(buckets.items()), "bucket int, version int").coalesce(1).write.parquet(f"{self.folder}/versions/{draft}")
        fs = self._fs()
        if fs.exists(self._path("versions", str(version))) or not fs.rename(self._path("versions", draft), self._path("versions", str(version))):
            fs.delete(self._path("versions", draft), True)
            raise Conflict(f"version {version} of {self.folder} is there already")
        return version

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the latest versions, and files that only those removed had."""
        fs, known = self._fs(), self.versions()
        gone, kept = known[:-keep], known[-keep:]
        used = {(v, b) for k in kept for b, v in self._buckets(k).items()}
        for v in gone:
            for b, w in self._buckets(v).items():
                if (w, b) not in used:
                    fs.delete(self._path("data", f"version={w}", f"bucket={b}"), True)
        for v in gone:
            fs.delete(self._path("versions", str(v)), True)
