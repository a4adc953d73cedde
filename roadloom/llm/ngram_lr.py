"""Quality classifier: hashed word n-gram logistic regression trained by follow-the-regularised-leader.

Features of a document are its hashed word unigrams and bigrams and the n-grams of its word forms
(case, digits, punctuation, length class, repetition of the word before), each with its relative
frequency. A score is the logistic of the sparse dot product, which for relative frequencies is
the mean weight over the n-grams of the text.

Defined results: null and empty texts have no n-gram and get the logistic of the bias; without
labelled rows all weights are 0 and scores 0.5, with one class only they are 0.98 or 0.02; repeated rows get equal scores; labels that occur
twice for a document count once, with the larger value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import crc_mod, labelled, map_texts, sigmoid, text_parts
from roadloom.llm.textbytes import LOWER, NOT_SPACE, bucket, find_words, hash_words, mix, release_memory, row_sums

BITS = 18
#: Rows per label value in the fit sample.
FIT_ROWS = 2500
GAIN = 20.0


def _class_counts(data: np.ndarray):
    upper = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    letter = ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128)
    return [np.concatenate([[0], np.cumsum(x)]) for x in (upper, digit, ~letter & ~digit)]


def word_forms(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A small code for the look of each word."""
    size = end - start
    upper, digit, other = (c[end] - c[start] for c in _class_counts(data))
    code = np.searchsorted([2, 4, 8, 14, 24], size)
    code = code * 3 + np.where(upper == 0, 0, np.where(upper + other >= size - 1, 2, 1))
    code = code * 3 + np.where(digit == 0, 0, np.where(digit + other == size, 2, 1))
    code = code * 4 + np.where(other == size, 3, np.minimum(other, 2))
    return code.astype(np.uint64)


def features(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Index arrays, all in word order, and each row's first word."""
    w = find_words(data, off, NOT_SPACE)
    h = hash_words(LOWER[data], w.start, w.end)
    form = word_forms(data, w.start, w.end)
    new = np.ones(len(h), bool)
    if len(h):
        new[1:] = w.row[1:] != w.row[:-1]
    before = np.zeros_like(h)
    before[1:] = h[:-1]
    before[new] = 1
    again = (h == before).astype(np.uint64)
    form = mix(form * np.uint64(2) + again, 5)
    f1 = np.zeros_like(form)
    f1[1:] = form[:-1]
    f1[new] = 2
    f2 = np.zeros_like(form)
    f2[1:] = f1[:-1]
    f2[new] = 3
    lex = [bucket(h, BITS, 1), bucket(h * np.uint64(31) + before, BITS, 2)]
    look = [bucket(form, BITS, 3), bucket(form * np.uint64(31) + f1, BITS, 4), bucket((form * np.uint64(31) + f1) * np.uint64(31) + f2, BITS, 5)]
    return lex + look, w.first


@dataclass
class NgramModel:
    weight: np.ndarray
    bias: float

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.logits_of(*features(data, off))

    def logits_of(self, index: list[np.ndarray], first: np.ndarray) -> np.ndarray:
        n = np.maximum(np.diff(first), 1)
        total = row_sums(sum((np.take(self.weight, i) for i in index[1:]), np.take(self.weight, index[0])), first)
        return self.bias + GAIN * total / n


def train(data: np.ndarray, off: np.ndarray, label: np.ndarray, epochs: int = 4, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> NgramModel:
    """Follow-the-regularised-leader (proximal) over the sample, one document at a time."""
    size = 1 << BITS
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    zb = nb = wb = 0.0
    index, first = features(data, off)
    rows = []
    for r in range(len(off) - 1):
        part = np.concatenate([i[first[r] : first[r + 1]] for i in index])
        i, c = np.unique(part, return_counts=True)
        rows.append((i, GAIN * c / max(1, first[r + 1] - first[r])))
    order = np.random.default_rng(8).permutation(len(rows))
    for _ in range(epochs):
        for r in order:
            i, x = rows[r]
            p = sigmoid(wb + (w[i] * x).sum())
            d = p - label[r]
            g = d * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w[i]
            n[i] += g * g
            zi = z[i]
            w[i] = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))
            sb = (np.sqrt(nb + d * d) - np.sqrt(nb)) / alpha
            zb += d - sb * wb
            nb += d * d
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
    return NgramModel(w.astype(np.float32), float(wb))


def fit(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> NgramModel:
    """Fits on a bounded sample of up to ``rows`` labelled documents of each class; scores have the labels' prior."""
    got, shift = labelled(docs, labels, label, 5, 0, rows)
    y = got.column("label").to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return NgramModel(np.zeros(1 << BITS, np.float32), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
    data, off = text_parts(got.column("text"))
    model = train(data, off, y)
    model.bias -= shift
    del got, data
    release_memory()
    return model


def score(docs: DataFrame, model: NgramModel, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda data, off: [sigmoid(m.logits(data, off))]

    return map_texts(docs, keep, "score double", make)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = fit(docs, labels, "quality")
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
