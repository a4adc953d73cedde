"""Fits and scores of the classifiers against plain versions of the same methods, a document at a time."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from roadloom.llm import langid, ngram_lr, toxicity
from roadloom.llm.textbytes import text_buffer

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = [
    ("en", "The cat sat on the mat, and the dog with it."), ("en", "this is what they said of the thing"), ("en", "A"), ("de", "Der Hund und die Katze sind nicht da."),
    ("de", "das ist ein ÜBERAUS kurzer Satz\twie dieser"), ("fr", "Le chat est sur la table, où ÉTÉ commence"), ("fr", "les chiens ne sont pas là"), ("es", "el perro no está en la casa"), ("es", "los niños van a la ESCUELA"),
]


def trigram_indexes(text):
    raw = bytearray(text.encode())
    for i, c in enumerate(raw):
        if 65 <= c <= 90:
            raw[i] = c + 32
        elif c in (9, 10, 11, 12, 13):
            raw[i] = 32
        elif 0x80 <= c <= 0x9E and c != 0x97 and i and raw[i - 1] == 0xC3:
            raw[i] = c + 32
    return [(((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - langid.BITS) for i in range(len(raw) - 2)]


def test_language_codes_and_decoding(spark):
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(TEXTS)], DOCS)
    model = langid.fit(docs)
    assert model.langs == ["de", "en", "es", "fr"] and model.code.shape == (4, 7)
    assert len({tuple(sorted((tuple(c), tuple(-c)))) for c in model.code.T.tolist() for c in [np.array(c)]}) == 7  # all splits, each once
    counts = {lang: Counter(i for k, t in TEXTS if k == lang for i in trigram_indexes(t)) for lang in model.langs}
    total = {lang: sum(c.values()) + 0.05 * (1 << langid.BITS) for lang, c in counts.items()}
    chance = lambda lang, i: (counts[lang][i] + 0.05) / total[lang]
    out = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"]).collect()}
    for n, (_, text) in enumerate(TEXTS):
        at = trigram_indexes(text)
        loss = dict.fromkeys(model.langs, 0.0)
        for bit in range(7):
            one = [lang for lang, c in zip(model.langs, model.code[:, bit], strict=True) if c > 0]
            none = [lang for lang in model.langs if lang not in one]
            weight = [math.log(sum(chance(x, i) for x in one) / len(one)) - math.log(sum(chance(x, i) for x in none) / len(none)) for i in at]
            margin = sum(weight) / max(1, len(at))
            for lang, c in zip(model.langs, model.code[:, bit], strict=True):
                loss[lang] += model.trust[bit] * math.log1p(math.exp(-model.scale * margin * c))
        best = min(sorted(loss), key=lambda lang: loss[lang])
        share = {lang: math.exp(-model.sharp * (x - loss[best])) for lang, x in loss.items()}
        two = sorted(x / sum(share.values()) for x in share.values())[-2:]
        assert out[n].lang_pred == best and abs(out[n].score - two[1]) < 1e-4
        assert out[n].ambiguous == (two[1] - two[0] < langid.AMBIGUOUS)


def test_language_of_long_texts_only(spark, monkeypatch):
    monkeypatch.setattr(langid, "FIT_TEXT_BYTES", 60)
    rows = [(i, t, lang, "s", 0) for i, (lang, t) in enumerate(TEXTS)] + [(50, "kissa istuu matolla ja koira nukkuu sen vieressä koko päivän", "fi", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    model = langid.fit(docs)
    assert "fi" in model.langs and {r.lang_pred for r in langid.predict(docs.where("doc_id = 50"), model, ["doc_id"]).collect()} == {"fi"}


def buffer(texts):
    return text_buffer(pa.array(texts, pa.string()))


def test_quality_updates_are_those_of_the_regularised_leader():
    texts = ["good plain words here", "BAD BAD!! 123", "more good words", "junk ### ###", "", "good good junk"]
    label = np.array([1.0, 0.0, 1.0, 0.0, 0.0, 1.0])
    alpha, beta, l1, l2, epochs = 0.3, 1.0, 0.002, 0.01, 3
    model = ngram_lr.train(*buffer(texts), label, epochs, alpha, beta, l1, l2)
    index, first = ngram_lr.features(*buffer(texts))
    rows = [Counter(int(i[k]) for i in index for k in range(first[r], first[r + 1])) for r in range(len(texts))]
    z, n, w, bias = Counter(), Counter(), Counter(), [0.0, 0.0, 0.0]
    for _ in range(epochs):
        for r in np.random.default_rng(8).permutation(len(rows)):
            size = max(1, first[r + 1] - first[r])
            x = {i: ngram_lr.GAIN * c / size for i, c in rows[r].items()}
            d = 1 / (1 + math.exp(-(bias[2] + sum(w[i] * v for i, v in x.items())))) - label[r]
            for i, v in x.items():
                g = d * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
                w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
            bias[0] += d - (math.sqrt(bias[1] + d * d) - math.sqrt(bias[1])) / alpha * bias[2]
            bias[1] += d * d
            bias[2] = -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)
    assert {i for i, v in w.items() if v} == set(np.flatnonzero(model.weight).tolist())
    assert all(abs(model.weight[i] - v) < 1e-5 for i, v in w.items()) and abs(model.bias - bias[2]) < 1e-9
    scores = ngram_lr.sigmoid(model.logits(*buffer(texts)))
    for r in range(len(texts)):
        size = max(1, first[r + 1] - first[r])
        dot = bias[2] + sum(w[i] * ngram_lr.GAIN * c / size for i, c in rows[r].items())
        assert abs(scores[r] - 1 / (1 + math.exp(-dot))) < 1e-5


def test_toxic_scores_follow_from_the_marginals(spark):
    texts = ["you idiot go away. a fine day", "a fine day", "the idiot came. and the idiots went! ok"] * 8
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 != 1)) for i in range(len(texts))], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    w, keys, sentence = toxicity.tokens(*buffer(texts[:3]))
    score = model.chain.scores(toxicity.fields(keys, sentence)).astype(float)
    logit = []
    for a, b in zip(sentence[:-1], sentence[1:], strict=True):  # every tag sequence of a sentence
        paths = [[(p >> t) & 1 for t in range(b - a)] for p in range(1 << (b - a))]
        value = [model.chain.begin[p[0]] + sum(score[a + t, s] for t, s in enumerate(p)) + sum(model.chain.trans[s, u] for s, u in zip(p, p[1:], strict=False)) for p in paths]
        for t in range(b - a):
            one, none = (np.logaddexp.reduce([v for p, v in zip(paths, value, strict=True) if p[t] == s]) for s in (1, 0))
            logit.append(one - none)
    got = {r.doc_id: r for r in toxicity.score(docs.where("doc_id < 3"), model, ["doc_id"]).collect()}
    for i in range(3):
        mine = np.array(logit)[w.row == i]
        x = [max(min(mine.max(), 15), -15), math.log((1 / (1 + np.exp(-mine))).sum() + 1e-4), math.log(len(mine) + 1), 1.0]
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-float(model.weights @ x))), abs=2e-3)
        assert got[i].n_offending == (mine > 0).sum()
