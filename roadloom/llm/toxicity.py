"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Token labels come from the labelled documents: a word or word beginning that the toxic documents
hold far more often than the clean ones (a likelihood-ratio test whose bar rises with the number
of candidates) labels its tokens toxic. The field is fitted on those labelled tokens; its features
are the hashed word, its beginnings of a few bytes, and the words beside it. A sentence is a
sequence. Forward-backward marginals give each token's probability; the document score is the
calibrated logistic of its largest marginal, its expected number of toxic tokens and its length; tokens over one half are its offending spans.

Defined results: null, empty and wordless texts get the lowest score and no span; without labelled
rows every score is 0.5, with one class only it is 0.98 or 0.02; repeated rows get equal
results; a document labelled twice counts once, as toxic if either row says so.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import crc_mod, labelled, logistic, map_texts, sigmoid, text_parts
from roadloom.llm.crf import Chain, fit as fit_chain, marginals
from roadloom.llm.textbytes import ALNUM, LOWER, Words, bucket, code_points, find_words, hash_words, mix, prefix_hash, release_memory, row_max, row_sums

BITS = 18
#: Rows per label value in the fit sample.
FIT_ROWS = 2500
#: Tokens that the field is fitted on, at most.
FIT_TOKENS = 400_000
#: Bytes of the word beginnings that serve as features.
BEGINNINGS = (4, 5, 7)
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True  # newline ! . ?


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[Words, list[np.ndarray], np.ndarray]:
    """Words, their hashes (word, beginnings) and the first word of each sentence."""
    low = LOWER[data]
    w = find_words(low, off, ALNUM)
    keys = [hash_words(low, w.start, w.end), *(prefix_hash(low, w.start, w.end, k) for k in BEGINNINGS)]
    new = np.ones(len(w.start), bool)
    if len(new):
        stops = np.concatenate([[0], np.cumsum(_ENDS[data])])
        new[1:] = (stops[w.start[1:]] > stops[w.end[:-1]]) | (w.row[1:] != w.row[:-1])
    return w, keys, np.append(np.flatnonzero(new), len(new))


def fields(keys: list[np.ndarray], sentence: np.ndarray) -> list[np.ndarray]:
    word = keys[0]
    left, right = np.zeros_like(word), np.zeros_like(word)
    left[1:], right[:-1] = word[:-1], word[1:]
    left[sentence[:-1]] = 1
    right[sentence[1:] - 1] = 2
    return [bucket(k, BITS, i) for i, k in enumerate([*keys, left, right])]


def copy_groups(word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A group number per row: rows whose three-word shingles agree in a band of two minima are copies.

    Copies of one document must not count as separate evidence for each of its words.
    """
    n = len(first) - 1
    group = np.arange(n)
    if len(word) < 3:
        return group
    shingle = np.zeros_like(word)
    shingle[:-2] = mix(word[:-2] ^ mix(word[1:-1] ^ mix(word[2:], 1), 2), 3)

    def root(i):
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    full = np.flatnonzero(first[1:] - first[:-1] >= 3)
    for band in range(4):
        low = [np.minimum.reduceat(mix(shingle, 10 + 2 * band + k), first[full]) for k in range(2)] if len(full) else []
        seen: dict[tuple[int, int], int] = {}
        for r, x, y in zip(full.tolist(), *(v.tolist() for v in low), strict=True) if low else ():
            other = seen.setdefault((x, y), r)
            if other != r:
                a, b = root(other), root(r)
                group[max(a, b)] = min(a, b)
    return np.array([root(i) for i in range(n)])


def indicative(keys: list[np.ndarray], row: np.ndarray, toxic: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """For each kind of key, the sorted keys that toxic documents hold significantly more often.

    Documents of one copy group count once.
    """
    unit = np.where(toxic, 1, 0) * len(toxic) + group  # a group counts once among the toxic and once among the clean
    ids, unit = np.unique(unit, return_inverse=True)
    bad_unit = ids >= len(toxic)
    n1, n0 = max(1, int(bad_unit.sum())), max(1, int((~bad_unit).sum()))
    counted = []
    for k in keys:
        of = unit[row]
        order = np.lexsort((of, k))
        ks, us = k[order], of[order]
        fresh = np.ones(len(ks), bool)
        fresh[1:] = (ks[1:] != ks[:-1]) | (us[1:] != us[:-1])
        ks, us = ks[fresh], us[fresh]
        head = np.ones(len(ks), bool)
        head[1:] = ks[1:] != ks[:-1]
        at = np.flatnonzero(head)
        bad = np.add.reduceat(bad_unit[us].astype(float), at)
        counted.append((ks[at], bad, np.diff(np.append(at, len(ks))) - bad))
    tried = sum(int(((a + b) >= 3).sum()) for _, a, b in counted)
    bar = 2 * np.log(max(tried, 2)) + 4
    out = []
    for key, a, b in counted:
        e1, e0 = (a + b) * n1 / (n1 + n0), (a + b) * n0 / (n1 + n0)
        g = 2 * (a * np.log(np.maximum(a, 1e-9) / e1) + b * np.log(np.maximum(b, 1e-9) / e0))
        out.append(key[(a >= 3) & (g > bar) & (a / n1 > 8 * b / n0)])
    return out


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def document_columns(w: Words, logit: np.ndarray) -> np.ndarray:
    """Largest token log-odds, log of the expected number of toxic tokens, log of the number of tokens."""
    first = w.first
    expected = row_sums(sigmoid(logit), first)
    return np.column_stack([row_max(logit, first, -15.0).clip(-15, 15), np.log(expected + 1e-4), np.log(np.diff(first) + 1.0)])


@dataclass
class ToxicityModel:
    chain: Chain | None
    weights: np.ndarray  # of the document columns and 1

    def document_scores(self, w: Words, logit: np.ndarray) -> np.ndarray:
        return sigmoid(np.column_stack([document_columns(w, logit), np.ones(len(w.off) - 1)]) @ self.weights)

    def token_logits(self, data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
        w, keys, sentence = tokens(data, off)
        if not len(w.start):
            return w, np.zeros(0)
        p, _ = marginals(self.chain, self.chain.scores(fields(keys, sentence)), sentence)
        return w, np.log(np.maximum(p[:, 1], 1e-12)) - np.log(np.maximum(p[:, 0], 1e-12))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """Fits on a bounded sample of up to ``rows`` labelled documents of each class; scores have the labels' prior."""
    got, shift = labelled(docs, labels, "toxic", 5, 0, rows)
    y = got.column("label").to_numpy().astype(bool)
    if len(y) == 0 or y.all() or not y.any():
        return ToxicityModel(None, np.array([0.0, 0.0, 0.0, 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)]))
    data, off = text_parts(got.column("text"))
    w, keys, sentence = tokens(data, off)
    known = indicative(keys, w.row, y, copy_groups(keys[0], w.first))
    label = np.zeros(len(w.start), np.int64)
    for k, kn in zip(keys, known, strict=True):
        label |= _member(k, kn)
    label[~y[w.row]] = 0
    # whole sentences: those with a labelled token, and others up to the bound
    hot = np.add.reduceat(label, sentence[:-1]) > 0
    size = np.diff(sentence)
    other = np.flatnonzero(~hot)
    other = other[np.argsort((other * 2654435761) % (1 << 32), kind="stable")]
    room = max(0, FIT_TOKENS - int(size[hot].sum()))
    other = other[np.cumsum(size[other]) <= room]
    pick = np.sort(np.concatenate([np.flatnonzero(hot), other]))
    at = np.concatenate([np.arange(sentence[s], sentence[s + 1]) for s in pick]) if len(pick) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(size[pick])])
    chain = fit_chain([f[at] for f in fields(keys, sentence)], label[at], first, BITS, 2)
    model = ToxicityModel(chain, np.zeros(4))
    w, logit = model.token_logits(data, off)
    model.weights = logistic(document_columns(w, logit), y.astype(float))
    model.weights[-1] -= shift
    del got, data, w, keys, logit
    release_memory()
    return model


def score(docs: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    """Adds score, n_offending and spans ("start:end" in code points, end exclusive)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def fn(data, off):
            n = len(off) - 1
            if m.chain is None:
                return np.full(n, float(sigmoid(m.weights[-1]))), np.zeros(n, np.int64), pa.array([""] * n, pa.string())
            w, logit = m.token_logits(data, off)
            bad = np.flatnonzero(logit > 0)
            count = np.bincount(w.row[bad], minlength=n)
            spans = [""] * n
            if len(bad):
                cp = code_points(data)
                s, e = cp[w.start[bad]] - cp[off[w.row[bad]]], cp[w.end[bad]] - cp[off[w.row[bad]]]
                for r, a, b in zip(w.row[bad].tolist(), s.tolist(), e.tolist(), strict=True):
                    spans[r] += f",{a}:{b}" if spans[r] else f"{a}:{b}"
            return m.document_scores(w, logit), count.astype(np.int64), pa.array(spans, pa.string())

        return fn

    return map_texts(docs, keep, "score double, n_offending bigint, spans string", make)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels)
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_offending", "spans"
    )
