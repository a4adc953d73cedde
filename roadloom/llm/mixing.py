"""Mixing to target weights with soft domain membership.

A classifier fitted on the label table predicts each document's posterior over the domains ``good``
(quality 1, not toxic), ``low`` (quality 0) and ``toxic``; its binary parts are the hashed n-gram
regressions of the quality operator. Nonnegative rates of the documents are then fitted by projected
gradient descent on the squared distance between the expected token totals of the domains,
sum(rate * tokens * posterior), and their targets. In each round a document's rate moves against its
gradient, posterior . multiplier, and is projected on 0 and up. The multiplier is the residual of the
domains divided by their curvature over the documents with a positive rate (a matrix of the domains'
size), halved until the distance falls, so rare domains converge as fast as frequent ones.

A round is one aggregation of a narrow table; the driver gets a few sums. A document's rate follows
from its posteriors and the list of multipliers, so ``resample`` makes the copies in the pass that
scores the text again: no text is joined or shuffled. A rate is an expected number of copies; the
dice are a hash of the id and the text.

Defined results: null and wordless texts have no tokens, weigh nothing and keep rate 1; an empty
table gives an empty result; repeated rows get equal rates and copies; other columns of docs may have any
name. Targets that the posteriors can't meet are approached as far as least squares goes: these rates
are used, with a warning and, in ``mix``, columns that tell by which share each domain misses its target.
``missed`` asks for an error or for an unmixed result (rates of 1) instead. Labels that don't know both
classes of quality and of toxicity define no domains: all rates are 1.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm import ngram_lr
from roadloom.llm.common import cut, map_texts, named, numbered, sigmoid, text_key, unit_hash
from roadloom.llm.ngram_lr import NgramModel

DOMAINS = ("good", "low", "toxic")
#: Shares of the expected tokens.
TARGETS = {"good": 0.90, "low": 0.07, "toxic": 0.03}
#: Without a size, the targets add up to what makes the first domain's HEADROOM times its own tokens,
#: so that its documents stay and the others are thinned out or repeated.
HEADROOM = 1.1
#: Rounds, many times those needed, and halvings of one step, before the nearest rates are taken as they are.
ROUNDS, HALVINGS = 300, 12
#: Distance from each domain's own target, as a share of it, at which the fit ends.
NEAR = 1e-4
#: Distance of a domain beyond which ``missed`` says what happens.
TOLERANCE = 0.1


def fit_classifier(docs: DataFrame, labels: DataFrame, rows: int = 1500) -> tuple[NgramModel, NgramModel]:
    """Quality and toxicity parts, each fitted on a bounded sample of the labelled documents."""
    return ngram_lr.fit(docs, labels, "quality", rows), ngram_lr.fit(docs, labels, "toxic", rows)


def posteriors(docs: DataFrame, parts: tuple[NgramModel, NgramModel], keep: list[str]) -> DataFrame:
    """Adds n_tokens and p_good, p_low, p_toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def make():
        quality, toxic = shared.value

        def fn(data, off):
            index, first = ngram_lr.features(data, off)
            q, t = (sigmoid(m.logits_of(index, first)) for m in (quality, toxic))
            return np.diff(first).astype(np.int64), q * (1 - t), (1 - q) * (1 - t), t

        return fn

    return map_texts(docs, keep, "n_tokens bigint, p_good double, p_low double, p_toxic double", make)


@dataclass
class Mixture:
    """multipliers: by round, what a rate loses per posterior. residuals: by domain, as a share of its target."""

    multipliers: list[list[float]]
    residuals: dict[str, float]

    @property
    def met(self) -> bool:
        return max(map(abs, self.residuals.values()), default=0.0) <= NEAR

    def rate(self) -> Column:
        """A document's rate from its columns n_tokens and p_*: the rounds applied one after the other."""
        if not self.multipliers:
            return F.lit(1.0)
        rounds = F.array(*(F.array(*map(F.lit, m)) for m in self.multipliers))

        def moved(rate: Column, m: Column) -> Column:
            return F.greatest(F.lit(0.0), rate - sum((m[i] * F.col(f"p_{d}") for i, d in enumerate(DOMAINS)), F.lit(0.0)))

        return F.when(F.col("n_tokens") > 0, F.aggregate(rounds, F.lit(1.0), moved)).otherwise(F.lit(1.0))


def fit_rates(soft: DataFrame, targets: dict[str, float] | None = None, size: float | None = None, rounds: int = ROUNDS) -> Mixture:
    """Projected gradient descent on soft (n_tokens, p_good, p_low, p_toxic).

    targets: shares by domain, a missing one is 0. size: tokens of the whole mixture; by default
    HEADROOM times the first domain's tokens over its share.
    """
    targets = targets or TARGETS
    k = len(DOMAINS)

    def measure(multipliers: list) -> tuple[np.ndarray, np.ndarray]:
        """Totals of the domains, and their curvature over the rows with a positive rate."""
        live = F.when(F.col("__r") > 0, F.col("n_tokens")).otherwise(F.lit(0))
        sums = [F.sum(F.col("__r") * F.col("n_tokens") * F.col(f"p_{d}")) for d in DOMAINS]
        sums += [F.sum(live * F.col(f"p_{d}") * F.col(f"p_{e}")) for d in DOMAINS for e in DOMAINS]
        row = soft.withColumn("__r", Mixture(multipliers, {}).rate()).agg(*(x.alias(str(i)) for i, x in enumerate(sums))).first()
        got = np.array([x or 0.0 for x in row], float)
        return got[:k], got[k:].reshape(k, k)

    steps: list[list[float]] = []
    have, curve = measure(steps)
    if have.sum() <= 0:
        return Mixture([], dict.fromkeys(DOMAINS, 0.0))
    share = np.array([targets.get(d, 0.0) for d in DOMAINS]) / sum(targets.values())
    if size is None:
        size = HEADROOM * have[0] / share[0] if share[0] > 0 and have[0] > 0 else have.sum()
    goal = share * size
    scale = np.maximum(goal, NEAR * size)
    for _ in range(rounds):
        residual = have - goal
        if (np.abs(residual) <= NEAR * scale).all():
            break
        inverse = np.linalg.pinv(curve, rcond=1e-10, hermitian=True)
        step, before = inverse @ residual, residual @ inverse @ residual
        if before <= 1e-12 * have.sum():
            break
        for half in range(HALVINGS):
            tried = [*steps, (step / 2**half).tolist()]
            now, bent = measure(tried)
            after = (now - goal) @ inverse @ (now - goal)
            if after <= before * (1 - 0.1 / 2**half):
                break
        else:
            break
        steps, have, curve = tried, now, bent
    left = dict(zip(DOMAINS, ((have - goal) / scale).tolist(), strict=True))
    out = Mixture(steps, left)
    if not out.met:
        warnings.warn(f"targets are out of reach; residuals as shares of the targets: {left}", stacklevel=2)
    return out


def copies(rate: Column, doc_id: Column, key: Column) -> Column:
    """A whole number of copies with the rate as its expectation over rows. key: of the text, as null and repeated ids occur."""
    return F.floor(rate + unit_hash(doc_id, key, F.lit(5))).cast("int")


def _fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None, size: float | None, missed: str) -> tuple[tuple, DataFrame, Mixture]:
    """docs: with __key, the key of the text."""
    if missed not in ("best", "raise", "unmixed"):
        raise ValueError(f"missed: best, raise or unmixed, not {missed}")
    parts = fit_classifier(docs, labels)
    soft = cut(posteriors(docs, parts, ["doc_id", "__key"]))
    if not all(m.weight.any() for m in parts):
        warnings.warn("targets are out of reach: the labels don't know both classes of quality and of toxicity", stacklevel=3)
        return parts, soft, Mixture([], dict.fromkeys(DOMAINS))
    found = fit_rates(soft, targets, size)
    if max(map(abs, found.residuals.values())) > TOLERANCE:
        if missed == "raise":
            raise ValueError(f"targets are out of reach: {found.residuals}")
        if missed == "unmixed":
            found = Mixture([], found.residuals)
    return parts, soft, found


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, size: float | None = None, missed: str = "best") -> DataFrame:
    """(doc_id, n_tokens, posteriors, rate, copies, misses) per row of docs.

    miss_<domain>: what the expected tokens are off the target, as a share of it; null without domains.
    """
    _, soft, found = _fit(docs.select("doc_id", "text").withColumn("__key", text_key()), labels, targets, size, missed)
    out = soft.withColumn("rate", found.rate()).withColumns({f"miss_{d}": F.lit(found.residuals[d]).cast("double") for d in DOMAINS})
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id"), F.col("__key"))).drop("__key")


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, size: float | None = None, missed: str = "best") -> DataFrame:
    """docs with each document as often as its rate says."""
    plain, names = numbered(docs)
    plain = plain.withColumn("__key", text_key())
    parts, _, found = _fit(plain, labels, targets, size, missed)
    scored = posteriors(plain, parts, [*names, "__key"])
    n = copies(found.rate(), F.col("doc_id"), F.col("__key"))
    return named(scored.withColumn("__i", F.explode(F.array_repeat(F.lit(0), n))), names, docs)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    return mix(docs, labels).select("doc_id", "n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "copies", *(f"miss_{d}" for d in DOMAINS))
