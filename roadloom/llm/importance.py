"""Importance resampling towards a target: hashed n-gram weights, found on suffix arrays of word ids.

The words of a block of texts become ids, and their suffix array (sorted by as many words as the longest
feature has) brings equal n-grams side by side: where the longest common prefix with the suffix before
is shorter than n words, a run of one n-gram begins. Each run is hashed once, and its bucket is scattered
back to all places where it occurs. Counts of documents and target are summed by bucket, a bucket's gain
is the logarithm of the ratio of the two, and a document's weight the mean gain over its features.
Documents are drawn without replacement by Gumbel noise on the weights: the highest scores win.

A task gives at most one count a bucket, the driver sees the bucket table alone (its size is a
parameter). What is drawn is found from counts by score (scores are whole numbers over a range that
grows with the logarithm of the corpus) and ranked over ranges, so no task sees all scores.

Defined results: null, empty and wordless texts have no features, weight 0 and are not drawn with fewer
words than the least; n-grams never cross texts; an empty target or corpus counts 0 everywhere; a null
doc_id draws its noise as an empty one and comes last in a tie; repeated rows each count and each can be
drawn; other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import cut, map_texts, named, numbered, small_batches, table
from roadloom.llm.ordering import placed
from roadloom.llm.textbytes import ALNUM, LOWER, blocks, find_words, hash_words, released, text_buffer

SEED = 2024
#: Words of the longest feature; buckets of the hash; share of the documents drawn; least words of a document that can be drawn.
LONGEST, BUCKETS, PERCENT, LEAST_WORDS = 1, 10_000, 10, 20


def word_ids(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal words get equal ids, other words other ones: by two 64-bit hashes of their bytes."""
    h, check = hash_words(data, start, end), hash_words(data, start, end, 1)
    _, rep, ids = np.unique(h, return_index=True, return_inverse=True)
    if (check != check[rep][ids]).any():
        _, ids = np.unique(np.rec.fromarrays([h, check]), return_inverse=True)
    return ids.astype(np.int64)


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` ids, and how many of those each shares with the one before.

    left: ids from each place to the end of its text, itself included; a suffix ends there.
    """
    n = len(ids)
    rank, width = ids, 1
    while width < depth:  # doubling: ranks of the first 2 * width ids from those of the first width
        then = np.full(n, -1, np.int64)
        then[: n - width] = np.where(left[: n - width] > width, rank[width:], -1)
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + then + 1, return_inverse=True)
        width *= 2
    order = np.argsort(rank, kind="stable")
    shared, same = np.zeros(n, np.int64), np.ones(max(n - 1, 0), bool)
    a, b = order[:-1], order[1:]
    for k in range(depth):
        inside = (left[a] > k) & (left[b] > k)
        same &= inside & (ids[np.minimum(a + k, n - 1)] == ids[np.minimum(b + k, n - 1)])
        shared[1:] += same
    return order, shared


def feature_buckets(data: np.ndarray, off: np.ndarray, longest: int, buckets: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For n = 1..longest the bucket of the n-gram at each word (-1 where its text ends before), and each text's first word."""
    data = LOWER[data]
    w = find_words(data, off, ALNUM)
    first = w.first
    left = first[1:][w.row] - np.arange(len(w.start))
    order, shared = suffix_array(word_ids(data, w.start, w.end), left, longest)
    raw, out = data.tobytes(), []
    for n in range(1, longest + 1):
        whole = left[order] >= n
        at = order[whole]
        begins = (shared < n)[whole]
        rep = at[begins]
        if n == 1:
            grams = [raw[a:b] for a, b in zip(w.start[rep].tolist(), w.end[rep].tolist(), strict=True)]
        else:
            spans = [list(zip(w.start[r : r + n].tolist(), w.end[r : r + n].tolist(), strict=True)) for r in rep.tolist()]
            grams = [b" ".join(raw[a:b] for a, b in s) for s in spans]
        once = np.array([zlib.crc32(g) % buckets for g in grams], np.int64)
        found = np.full(len(w.start), -1, np.int64)
        if len(at):
            found[at] = once[np.cumsum(begins) - 1]
        out.append(found)
    return out, first


def bucket_counts(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            data, off = text_buffer(b.column(0))
            for lo, hi in blocks(off):
                found, _ = feature_buckets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], longest, buckets)
                for x in found:
                    total += np.bincount(x[x >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(released(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the ratio of smoothed shares, floored."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


@dataclass(frozen=True)
class Weights:
    """What scores a text: a gain by bucket."""

    gains: np.ndarray
    longest: int = LONGEST

    @staticmethod
    def fit(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> Weights:
        return Weights(bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)), longest)

    def score(self, docs: DataFrame, keep: list[str], doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
        """keep, n_words, n_features, weight and score of each row."""
        shared = docs.sparkSession.sparkContext.broadcast((np.append(self.gains, 0), self.longest))

        def make():
            gains, longest = shared.value

            def fn(data, off):
                found, first = feature_buckets(data, off, longest, len(gains) - 1)
                words = np.diff(first)
                n, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
                for k, x in enumerate(found):
                    n += np.maximum(words - k, 0)
                    total += np.diff(np.concatenate([[0], np.cumsum(gains[x])])[first])  # -1 is the last gain, 0
                return words, n, total // np.maximum(n, 1)

            return fn

        out = map_texts(docs, keep, "n_words bigint, n_features bigint, weight bigint", make)
        return out.withColumn("score", F.col("weight") + noise(F.col(doc_id), seed))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate from the id, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, ... for the drawn rows, else null. scored: repeatable."""
    able = F.col("n_words") >= least_words
    counts = sorted(((r[0], r[1]) for r in scored.where(able).groupBy("score").count().collect()), reverse=True)
    want = percent * sum(n for _, n in counts) // 100
    rows, least = 0, None
    for score, n in counts:
        if rows >= want:
            break
        rows, least = rows + n, score
    none = F.lit(None).cast("long")
    if least is None:
        return scored.withColumn("rank", none)
    near = able & (F.col("score") >= least)
    placed_rows = placed(scored.where(near), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()])
    drawn = placed_rows.withColumn("rank", F.when(F.col("place") < want, F.col("place") + 1)).drop("place")
    return drawn.unionByName(scored.where(~near).withColumn("rank", none))


def draw(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs."""
    return ranked(cut(Weights.fit(docs, target, longest, buckets).score(docs, ["doc_id"], seed=seed)), percent, least_words)


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn rows of docs, whole. Texts are scored again and none is shuffled.

    Rows with the id and the score of the last one drawn all stay.
    """
    weights = Weights.fit(docs, target, longest, buckets)
    found = ranked(cut(weights.score(docs, ["doc_id"], seed=seed)), percent, least_words)
    last = found.where("rank is not null").agg(F.max_by(F.struct("score", "doc_id"), "rank")).first()[0]
    plain, names = numbered(docs)
    scored = weights.score(plain, names, seed=seed)
    if last is None:
        return named(scored.where("false"), names, docs)
    first_ids = F.lit(True) if last["doc_id"] is None else F.col("doc_id") <= F.lit(last["doc_id"])
    stays = (F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & F.coalesce(first_ids, F.lit(False)))
    return named(scored.where(stays & (F.col("n_words") >= least_words)), names, docs)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return draw(docs, table(spark, sf_dir, "benchmark").select("text")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of hexadecimal digits, step by step with a table of 256 values.
CRC_SQL = """
crc_table AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))"""


def crc_sql(text: str) -> str:
    """SQL of the CRC-32 of a text's UTF-8 bytes; crc_table must be in reach as t."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(0, length({digits}), 2), lambda i: ('0x' || substr({digits}, (i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLE_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS_SQL} AS w FROM documents),
dw AS (SELECT rid, unnest(w) AS g FROM d),
bw AS (SELECT unnest({_WORDS_SQL}) AS g FROM benchmark),
kinds AS (SELECT g, {crc_sql('g')} % 10000 AS b FROM (SELECT g FROM dw UNION SELECT g FROM bw), crc_table),
s AS (SELECT b, count(*) AS n FROM dw JOIN kinds USING (g) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN kinds USING (g) GROUP BY b),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS sn, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS tn),
gains AS (
  SELECT g, floor(1000 * ln((coalesce(t.n, 0) + 1) * (sn + 10000) / ((coalesce(s.n, 0) + 1) * (tn + 10000))))::BIGINT AS gain
  FROM kinds LEFT JOIN s USING (b) LEFT JOIN t USING (b), totals),
weights AS (SELECT rid, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM dw JOIN gains USING (g) GROUP BY rid),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (rid)),
able AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, (CASE WHEN n_features >= 20 AND r <= (10 * n) // 100 THEN r END)::BIGINT AS rank FROM able
"""
