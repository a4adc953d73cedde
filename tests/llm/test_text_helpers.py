"""Byte helpers and the conditional random field against brute force."""

import itertools
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from roadloom.llm import crf
from roadloom.llm import textbytes as tb

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 é\n.€x", max_size=30)), max_size=8)


@given(texts)
@settings(max_examples=100, deadline=None)
def test_words_match_a_pattern(rows):
    data, off = tb.text_buffer(pa.array(rows, pa.string()))
    w = tb.find_words(data, off, tb.NOT_SPACE)
    got = [(int(r), data[s:e].tobytes().decode()) for r, s, e in zip(w.row, w.start, w.end, strict=True)]
    want = [(i, x) for i, t in enumerate(rows) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
    assert got == want
    h = tb.hash_words(data, w.start, w.end)
    assert len(set(h.tolist())) == len({x for _, x in want})


def test_slices_and_nulls():
    col = pa.array(["ab", None, "c d", ""]).slice(1, 3)
    data, off = tb.text_buffer(col)
    assert data.tobytes() == b"c d" and off.tolist() == [0, 0, 3, 3]
    assert tb.text_buffer(pa.array([], pa.string()))[1].tolist() == [0]
    assert list(tb.blocks(np.array([0, 5, 5, 100, 101]), 10)) == [(0, 2), (2, 3), (3, 4)]


def test_hash_crosses_blocks():
    word = b"x" * (tb._SPAN + 10)
    data = np.frombuffer(b"ab " + word + b" ab", np.uint8)
    w = tb.find_words(data, np.array([0, len(data)]), tb.NOT_SPACE)
    h = tb.hash_words(data, w.start, w.end)
    assert h[0] == h[2] != h[1]


def chain(k, seed):
    rng = np.random.default_rng(seed)
    return crf.Chain([], np.zeros(k), rng.normal(size=(k, k)), rng.normal(size=k)), rng


def test_marginals_and_viterbi_match_enumeration():
    for k in (2, 3):
        c, rng = chain(k, k)
        sizes = [4, 1, 3]
        first = np.concatenate([[0], np.cumsum(sizes)])
        s = rng.normal(size=(first[-1], k))
        p, z = crf.marginals(c, s, first)
        best = crf.viterbi(c, s, first)
        for q, (a, b) in enumerate(zip(first, first[1:], strict=False)):
            paths = list(itertools.product(range(k), repeat=b - a))
            score = np.array([c.begin[y[0]] + sum(s[a + t, y[t]] for t in range(b - a)) + sum(c.trans[y[t], y[t + 1]] for t in range(b - a - 1)) for y in paths])
            assert np.isclose(np.log(np.exp(score).sum()), z[q])
            w = np.exp(score - z[q])
            for t in range(b - a):
                assert np.allclose(p[a + t], [w[[y[t] == j for y in paths]].sum() for j in range(k)])
            assert tuple(best[a:b]) == paths[int(score.argmax())]


def test_fit_learns_a_word():
    rng = np.random.default_rng(0)
    idx = rng.integers(0, 50, 600)
    label = (idx == 7).astype(np.int64)
    first = np.arange(0, 601, 10)
    m = crf.fit([idx], label, first, 8, 2)
    assert (crf.viterbi(m, m.scores([idx]), first) == label).all()
