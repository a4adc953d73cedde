"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword of bits; a binary n-gram classifier predicts each bit from hashed
byte trigrams (log odds of the languages whose bit is 1 against those whose bit is 0). Decoding
sums, for each language, the logistic losses of its codeword's bits, weighted by how reliable each
bit was on the fit sample, and takes the nearest codeword. A near tie is flagged as ambiguous.

Defined results: null, empty and letterless texts give ``und`` with score 0; equal losses give the
language first in alphabetical order; with no labelled row every text is ``und``; with one
language every text with a letter gets it with score 1. Repeated rows get equal results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import FIT_TEXT_BYTES, bounded_sample, crc_mod, map_texts, sampling_shares, text_parts
from roadloom.llm.textbytes import LOWER, NOT_SPACE, blocks, release_memory, row_sums

BITS = 16
#: Rows per language in the fit sample.
FIT_ROWS = 1000
#: Rows of a language that has only texts beyond the bound of the sample.
LONG_ROWS = 3
#: Below this difference of the two best probabilities a prediction is ambiguous.
AMBIGUOUS = 0.1


def codewords(n: int) -> np.ndarray:
    """(n, bits) codes in {-1, 1}: all splits of up to five languages, else spread random columns."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        cols = [[1 if lang == 0 or not (c >> (lang - 1)) & 1 else -1 for lang in range(n)] for c in range(1, 2 ** (n - 1))]
        return np.array(cols, np.int8).T
    bits = int(np.ceil(15 * np.log2(n)))
    rng = np.random.default_rng(20)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        gap = (code[:, None, :] != code[None]).sum(axis=2)
        gap = gap[~np.eye(n, dtype=bool)].min()
        if gap > apart and (np.abs(code.sum(axis=0)) < n).all():
            best, apart = code, gap
    return best


def trigrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature index for each byte that begins a trigram inside its row, and each row's first one."""
    low = LOWER[data]
    if len(data):
        up = (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
        up[1:] &= low[:-1] == 0xC3
        up[0] = False
        low = np.where(up, low + 0x20, low)
        low[~NOT_SPACE[low]] = 32
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    x = low.astype(np.uint32)
    h = (x[:-2] | (x[1:-1] << 8) | (x[2:] << 16)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
    ok = np.ones(len(h), bool)
    for back in (1, 2):
        at = off[1:-1] - back
        ok[at[(at >= 0) & (at < len(h))]] = False
    first = np.concatenate([[0], np.cumsum(ok)])[np.minimum(off, len(h))]
    return h[ok].astype(np.int64), first


@dataclass
class LanguageModel:
    langs: list[str]
    code: np.ndarray
    weight: np.ndarray  # (2 ** BITS, bits)
    trust: np.ndarray  # (bits,)
    scale: float
    sharp: float

    def margins(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        h, first = trigrams(data, off)
        n = np.maximum(np.diff(first), 1)[:, None]
        return row_sums(np.take(self.weight, h, axis=0), first) / n

    def posterior(self, margin: np.ndarray) -> np.ndarray:
        loss = np.logaddexp(0, -self.scale * margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(-self.sharp * (loss - loss.min(axis=1, keepdims=True)))
        return p / p.sum(axis=1, keepdims=True)


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> LanguageModel:
    """Fits on a bounded sample of ``rows`` documents a language; docs: (doc_id, text, lang).

    The sample holds texts up to FIT_TEXT_BYTES; a language that has longer ones only gives its shortest.
    """
    docs = docs.where(F.col("text").isNotNull()).select("doc_id", "lang", "text")
    short = docs.where(F.octet_length("text") <= FIT_TEXT_BYTES)
    every, there = sampling_shares(docs, "lang", rows), sampling_shares(short, "lang", rows)
    got = bounded_sample(short, "doc_id", "lang", rows, ["doc_id", "lang", "text"], there)
    long = [docs.where(F.col("lang") == lang).orderBy(F.octet_length("text"), "doc_id").limit(LONG_ROWS).toArrow() for lang in sorted(set(every) - set(there))]
    got = pa.concat_tables([got, *(x.cast(got.schema) for x in long)])
    lang = np.array(got.column("lang").to_pylist(), dtype=object)
    langs = sorted(set(lang))
    code = codewords(len(langs))
    size = 1 << BITS
    if len(langs) < 2:
        return LanguageModel(langs, code, np.zeros((size, 0), np.float32), np.zeros(0), 1.0, 1.0)
    data, off = text_parts(got.column("text"))
    which = np.searchsorted(np.array(langs, dtype=object), lang)
    p = np.full((len(langs), size), 0.05)
    for a, b in blocks(off):
        h, first = trigrams(data[off[a] : off[b]], off[a : b + 1] - off[a])
        owner = np.repeat(which[a:b], np.diff(first))
        for k in np.unique(owner).tolist():
            p[k] += np.bincount(h[owner == k], minlength=size)
    p /= p.sum(axis=1, keepdims=True)
    weight = np.stack([np.log(p[c > 0].mean(axis=0) / p[c < 0].mean(axis=0)) for c in code.T], axis=1).astype(np.float32)
    model = LanguageModel(langs, code, weight, np.ones(code.shape[1]) / code.shape[1], 1.0, 1.0)
    margin = np.concatenate([model.margins(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in blocks(off)])
    right = (np.sign(margin) == code[which]).mean(axis=0)
    model.trust = np.maximum(right - 0.5, 0.01)
    model.trust /= model.trust.sum()
    best = np.inf
    for scale in (1.0, 2.0, 4.0, 8.0):
        for sharp in (2.0, 4.0, 8.0, 16.0):
            model.scale, model.sharp = scale, sharp
            cost = -np.log(model.posterior(margin)[np.arange(len(which)), which] + 1e-9).mean()
            if cost < best - 1e-6:
                best, chosen = cost, (scale, sharp)
    model.scale, model.sharp = chosen
    del got, data
    release_memory()
    return model


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    low = data | 32
    ascii_letter = (low >= 97) & (low <= 122)
    count = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = count[off[1:]] > count[off[:-1]]
    other = np.concatenate([[0], np.cumsum(data >= 0x80)])
    for i in np.flatnonzero(~out & (other[off[1:]] > other[off[:-1]])):
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """Adds lang_pred, score and ambiguous to the ``keep`` columns; whole texts are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        names = np.array([*m.langs, "und"], dtype=object)

        def fn(data, off):
            n = len(off) - 1
            letter = has_letter(data, off)
            if not m.langs:
                return pa.array(["und"] * n, pa.string()), np.zeros(n), np.zeros(n, bool)
            if len(m.langs) == 1:
                return pa.array(np.where(letter, m.langs[0], "und"), pa.string()), letter.astype(float), np.zeros(n, bool)
            p = m.posterior(m.margins(data, off))
            best = p.argmax(axis=1)
            two = np.sort(p, axis=1)[:, -2:]
            pred = np.where(letter, best, len(m.langs))
            score = np.where(letter, two[:, 1], 0.0)
            return pa.array(names[pred], pa.string()), score, letter & (two[:, 1] - two[:, 0] < AMBIGUOUS)

        return fn

    return map_texts(docs, keep, "lang_pred string, score double, ambiguous boolean", make)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit(docs.where(~held))
    return predict(docs, model, ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
