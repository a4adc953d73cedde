"""What the text operators share: inputs, bounded samples, shared storage, block maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.textbytes import blocks, released, text_buffer

#: Rows of a fit sample whose text is longer are left out of it (they are still scored whole).
FIT_TEXT_BYTES = 20_000
#: Key sets up to this many rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Values that a column of classes may have.
MAX_STRATA = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: Column, mod: int) -> Column:
    return F.crc32(doc_id.cast("string")) % mod


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set, a local session (one process, as in tests) gets a temporary one; on a cluster
    that is an error, as executors could not see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = current
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="roadloom-")
    if current is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage at a copy in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unit_hash(*cols: Column) -> Column:
    """A repeatable value in [0, 1) for each row."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with all columns but doc_id and text under numbers, so that no name can clash; and its names.

    ``named`` undoes it.
    """
    names = [c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def named(df: DataFrame, names: list[str], docs: DataFrame) -> DataFrame:
    return df.select(*names).toDF(*docs.columns)


def text_key() -> Column:
    """128 bits of SHA-256 over the text, null texts apart from empty ones: with doc_id it tells rows apart."""
    digest = F.unhex(F.substring(F.sha2(F.col("text"), 256), 1, 32))
    return F.coalesce(digest, F.lit(b""))


def sampling_shares(df: DataFrame, stratum: str, rows: int) -> dict:
    """By stratum the share of its rows that a sample of about ``rows`` rows takes. Null strata are left out."""
    counts = df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().limit(MAX_STRATA + 1).collect()
    if len(counts) > MAX_STRATA:
        raise ValueError(f"{stratum} has more than {MAX_STRATA} values: no column of classes")
    return {r[0]: min(1.0, rows / r[1]) for r in counts}


def bounded_sample(df: DataFrame, key: str, stratum: str, rows: int, columns: list[str], shares: dict | None = None) -> pa.Table:
    """About ``rows`` rows of each stratum, chosen by a hash of the key, brought to the driver.

    The number of rows is bounded (``limit`` guards against a key that repeats), and so is their
    size if the caller has bounded the text of a row. Null strata are left out.
    """
    shares = sampling_shares(df, stratum, rows) if shares is None else shares
    if not shares:
        return df.select(*columns).limit(0).toArrow()
    share = F.lit(0.0)
    for value, part in shares.items():
        share = F.when(F.col(stratum) == F.lit(value), F.lit(part)).otherwise(share)
    picked = df.where(unit_hash(F.col(key), F.lit(7)) < share).select(*columns).limit(2 * rows * len(shares))
    out = picked.toArrow()
    return out.sort_by([(key, "ascending")]) if key in columns else out


def labelled(docs: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int) -> tuple[pa.Table, float]:
    """A bounded sample (doc_id, text, label) of the documents that the label table covers, and its shift.

    Only rows off the held-out fold count. The sample is drawn from the label table first, so the
    join sees a bounded set of ids and never moves text. The shift is what the sample's class shares
    add to the log-odds of label 1; a fitted intercept less the shift has the label table's prior.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), mod) != held))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    shares = sampling_shares(known, "label", rows)
    shift = float(np.log(shares.get(1, 1.0) / shares.get(0, 1.0)))
    ids = bounded_sample(known, "doc_id", "label", rows, ["doc_id", "label"], shares)
    spark = docs.sparkSession
    if ids.num_rows == 0:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "label": pa.array([], pa.int32())}), 0.0
    small = spark.createDataFrame(ids.to_pandas())
    out = (
        docs.select("doc_id", "text")
        .where(F.octet_length("text") <= FIT_TEXT_BYTES)
        .join(F.broadcast(small), "doc_id")
        .limit(4 * rows)
        .toArrow()
    )
    return out.sort_by([("doc_id", "ascending")]), shift


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of a batch that goes to Python, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def map_texts(df: DataFrame, keep: list[str], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Maps whole texts in blocks: ``make()`` gives fn(data, off) -> new columns, once a task.

    keep: columns passed through unchanged. The result has them and then ``schema``; a new column
    takes the place of a kept one with its name.
    """
    made_names = [x.split()[0] for x in schema.split(", ")]
    keep = [k for k in keep if k.lower() not in made_names]
    kinds = dict(df.dtypes)
    at = keep.index("text") if "text" in keep else len(keep)
    inner = [f"k{i}" for i in range(len(keep))]
    full = ", ".join([*(f"{n} {kinds[k]}" for n, k in zip(inner, keep, strict=True)), *(f"m{i} {x.split(maxsplit=1)[1]}" for i, x in enumerate(schema.split(", ")))])

    def run(batches):
        fn = make()
        for b in batches:
            data, off = text_buffer(b.column(at))
            for lo, hi in blocks(off):
                made = fn(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                cols = [b.column(i).slice(lo, hi - lo) for i in range(len(inner))] + [x if isinstance(x, pa.Array) else pa.array(x) for x in made]
                yield pa.RecordBatch.from_arrays(cols, names=[*inner, *(f"m{i}" for i in range(len(made_names)))])

    small_batches(df.sparkSession)
    sent = [F.col(f"`{k}`").alias(n) for n, k in zip(inner, keep, strict=True)]
    if at == len(keep):
        sent.append(F.col("text").alias("t"))
    return df.select(*sent).mapInArrow(released(run), full).toDF(*keep, *made_names)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression on a few columns, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    pull = np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, x.T @ (p - y) + pull * w)
        w -= step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def text_parts(text: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    return text_buffer(col)
