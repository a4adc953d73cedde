"""Five stages from raw documents to token files; each works on all that the one before it kept.

The stages before the last return the columns of documents, whatever other columns those have: names
that an operator uses itself don't clash. Null ids and texts, empty tables and repeated rows have the
results that the stages state. ``run`` writes each stage's rows as Parquet in the shared folder, reads
them again for the next one, and removes them when that one is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import decontaminate, langid, mixing, simhash, token_files
from roadloom.llm.common import crc_mod, discard, named, numbered, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: null, empty and letterless texts.

    Repeated rows share one fate and all stay or go; ties of languages are no ground to go.
    """
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = langid.fit(docs.select("doc_id", "text", "lang").where(~held))
    plain, names = numbered(docs)
    return named(langid.predict(plain, model, names).where("lang_pred <> 'und'"), names, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the smallest id, then text key; of repeated rows one."""
    return simhash.keep_one(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; repeated rows share one fate; an empty benchmark keeps all."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the domains' token totals meet their targets.

    Out of reach, the targets are met as far as least squares goes, with a warning. Labels that know one
    class only leave all documents as they are.
    """
    return mixing.resample(docs, table(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back as one row per document. Workers don't hold tables of pieces, as other stages may follow."""
    return token_files.encode_and_read(docs, keep=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_copies", near_copies),
    ("leaks", leaks),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Learned models and SimHash stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            discard(spark, before)
        before = out
    return docs
