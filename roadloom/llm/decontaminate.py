"""Benchmark decontamination with DataFrame functions only.

The ten-word windows of the benchmark items (a shorter item is one window) form a hash set that is
broadcast after a check of its size; beyond that size the same join is a shuffle join. Each
document is scanned once: its windows are hashed, looked up, and a hit is verified word by word.
Hits are gathered per document; spans of hit words or whole documents can then be removed.

Defined results: null and wordless texts have no words and no hit; null or wordless items have no
window; an item id that occurs twice counts once; repeated documents each give a row; a document
word inside several windows counts once; other columns of docs may have any name. A document is
found again by its id and 128 bits of SHA-256 over its text, so rows with one id stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import BROADCAST_ROWS, cut, named, numbered, text_key

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, once A-Z are lower case, and before that.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_RAW_SEPARATORS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"


def words(text: Column) -> Column:
    """Normalised words; A-Z alone are lowered (lower() does just that where all is ASCII)."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(low, _SEPARATORS), "")


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct window: width, w_text and the sorted ids of the items that have it."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    item = item.withColumn("width", F.least(F.lit(size), F.size("w")))
    each = item.select("item", "width", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("width") + 1), lambda i: F.slice("w", i, F.col("width")))).alias("window"))
    return (
        each.groupBy("width", "window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select("width", F.array_join("window", " ").alias("w_text"), "items")
    )


def with_window_hashes(df: DataFrame, widths: list[int], column: str = "w") -> DataFrame:
    """Adds hash_<width>: the hash of each window of so many words, null where there are too few.

    Hashes of 1, 2, 4, ... words are combined in pairs, so a window costs a few hashes of two numbers
    instead of one over all its words. Each step is a column of its own, computed once.
    """
    step, levels = 1, {1: "__h1"}
    df = df.withColumn("__h1", F.transform(column, lambda x: F.xxhash64(x)))

    def paired(left: str, right: str, by: int):
        return F.zip_with(left, F.slice(right, by + 1, F.greatest(F.size(right) - by, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    while 2 * step <= max(widths):
        levels[2 * step] = f"__h{2 * step}"
        df = df.withColumn(levels[2 * step], paired(levels[step], levels[step], step))
        step *= 2
    for width in widths:
        bits = [b for b in sorted(levels, reverse=True) if width & b]
        now, size = levels[bits[0]], bits[0]
        for k, b in enumerate(bits[1:]):
            df = df.withColumn(f"__h{width}_{k}", paired(now, levels[b], size))
            now, size = f"__h{width}_{k}", size + b
        df = df.withColumn(f"hash_{width}", F.when(F.size(column) >= width, F.slice(now, 1, F.greatest(F.size(column) - width + 1, F.lit(0)))))
    return df.drop(*(c for c in df.columns if c.startswith("__h")))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, keyed: bool = False) -> DataFrame:
    """Per row of docs: row_key, doc_id, n_words, spans (word ranges, start included, end not), items.

    keyed: with the column text_key, which beside doc_id tells rows apart.
    """
    known = item_windows(benchmark, size)
    widths = sorted(r[0] for r in known.select("width").distinct().collect())
    own = ["row_key", "doc_id", "text_key", "n_words"] if keyed else ["row_key", "doc_id", "n_words"]
    base = docs.select(
        "doc_id",
        text_key().alias("text_key"),
        words(F.col("text")).alias("w"),
        F.monotonically_increasing_id().alias("row_key"),
    ).withColumn("n_words", F.size("w").cast("long"))
    if not widths:
        none = F.array().cast("array<struct<start:int,stop:int>>")
        return base.select(*own, none.alias("spans"), F.array().cast("array<string>").alias("items"))
    hashed = with_window_hashes(known.withColumn("w", F.split("w_text", " ")), widths)
    hash_of = F.coalesce(*(F.when(F.col("width") == k, F.get(f"hash_{k}", F.lit(0))) for k in widths))
    known = cut(hashed.select("width", hash_of.alias("w_hash"), "w_text", "items"))
    small = known.agg(F.sum(F.size("items") + 1)).first()[0] <= BROADCAST_ROWS
    base = with_window_hashes(base, widths)
    kept = [*own, "w"]
    if len(widths) == 1:
        each = base.select(*kept, F.posexplode_outer(f"hash_{widths[0]}").alias("at", "hash"), F.lit(widths[0]).alias("wide"))
    else:
        of = F.explode(F.array(*(F.struct(F.lit(k).alias("wide"), F.col(f"hash_{k}").alias("hashes")) for k in widths)))
        each = base.select(*kept, of.alias("of")).select(*kept, F.posexplode_outer("of.hashes").alias("at", "hash"), F.col("of.wide").alias("wide"))
    lead = (F.coalesce(F.col("at"), F.lit(0)) == 0) & (F.col("wide") == widths[0])
    window = F.array_join(F.slice("w", F.col("at") + 1, F.col("wide")), " ")
    if small:
        known = F.broadcast(known)
        same = window == F.col("w_text")
    else:  # the words themselves don't travel
        each = each.select(*own, "at", "hash", "wide", window.alias("window"))
        same = F.col("window") == F.col("w_text")
    hit = F.col("w_text").isNotNull()
    found = (
        each.join(known, (F.col("hash") == F.col("w_hash")) & (F.col("wide") == F.col("width")) & same, "left")
        .where(hit | lead)
        .select(*own, F.when(hit, F.struct(F.col("at").alias("start"), (F.col("at") + F.col("wide")).alias("stop"))).alias("span"), "items")
    )
    return found.groupBy(*own).agg(
        F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
    )


def covered(spans: Column) -> Column:
    """Number of positions in the union of ranges that are sorted by their start."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    return F.aggregate(
        spans,
        zero,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["reach"], s["start"]))).alias("n"), F.greatest(a["reach"], s["stop"]).alias("reach")),
        lambda a: a["n"].cast("long"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", size: int = WINDOW) -> DataFrame:
    """docs without contaminated documents, or (mode "spans") without the hit words in them.

    Only the keys and spans of contaminated documents meet the corpus again: by a broadcast if
    there are few of them, else by a shuffle join.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    plain, names = numbered(docs)
    bad = scan(plain, benchmark, size, keyed=True).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("__id"), "text_key").agg(F.first("spans").alias("__spans"))
    bad = cut(bad if mode == "spans" else bad.drop("__spans"))
    load = bad.agg(F.sum(F.size("__spans")) if mode == "spans" else F.count("*")).first()[0] or 0
    key = F.col("doc_id").eqNullSafe(F.col("__id")) & (text_key() == F.col("text_key"))
    side = F.broadcast(bad) if load <= BROADCAST_ROWS else bad
    if mode == "documents":
        return named(plain.join(side, key, "left_anti"), names, docs)
    piece = F.regexp_extract_all("text", F.lit(f"([{_RAW_SEPARATORS}]*[^{_RAW_SEPARATORS}]+)"), F.lit(1))
    tail = F.regexp_extract("text", f"[{_RAW_SEPARATORS}]*\\z", 0)
    clean = F.concat(F.array_join(F.filter(piece, lambda _p, i: ~F.exists("__spans", lambda s: (i >= s["start"]) & (i < s["stop"]))), ""), tail)
    text = F.when(F.col("__spans").isNotNull(), clean).otherwise(F.col("text"))
    return named(plain.join(side, key, "left").withColumn("text", text), names, docs)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    n_hit = covered(F.col("spans"))
    return scan(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, list_slice(w, i, i + k - 1) AS wnd
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), dw AS (
  SELECT r, k, i, list_slice(w, i, i + k - 1) AS wnd
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hit AS (SELECT r, i, dw.k AS k, item FROM dw JOIN win ON dw.k = win.k AND dw.wnd = win.wnd),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
