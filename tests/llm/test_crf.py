"""The chain against enumeration of all tag sequences and against finite differences."""

import itertools

import numpy as np
import pytest

from roadloom.llm import crf


def random_chain(seed, k=3, size=8):
    rng = np.random.default_rng(seed)
    emit = [rng.normal(0, 1, (size, k)) for _ in range(2)]
    chain = crf.Chain(emit, rng.normal(0, 1, k), rng.normal(0, 1, (k, k)), rng.normal(0, 1, k))
    first = np.array([0, 4, 5, 8, 12])
    index = [rng.integers(0, size, 12) for _ in range(2)]
    return chain, index, first, rng.integers(0, k, 12)


def enumerated(chain, scores, k=3):
    """Of one sequence: each tag sequence and its score."""
    for tags in itertools.product(range(k), repeat=len(scores)):
        s = chain.begin[tags[0]] + sum(scores[t, j] for t, j in enumerate(tags)) + sum(chain.trans[i, j] for i, j in itertools.pairwise(tags))
        yield tags, s


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_expectations_and_best_path_match_enumeration(seed):
    chain, index, first, _ = random_chain(seed)
    scores = chain.scores(index)
    p, pairs, log_z = crf.expectations(chain, scores, first)
    want_p, want_pairs, path = np.zeros_like(p), np.zeros((3, 3)), []
    for s, (a, b) in enumerate(itertools.pairwise(first)):
        each = list(enumerated(chain, scores[a:b]))
        z = np.logaddexp.reduce([v for _, v in each])
        assert np.isclose(log_z[s], z)
        path += max(each, key=lambda x: x[1])[0]
        for tags, v in each:
            for t, j in enumerate(tags):
                want_p[a + t, j] += np.exp(v - z)
            for i, j in itertools.pairwise(tags):
                want_pairs[i, j] += np.exp(v - z)
    assert np.allclose(p, want_p) and np.allclose(pairs, want_pairs)
    assert np.allclose(crf.marginals(chain, scores, first)[0], want_p)
    assert crf.viterbi(chain, scores, first).tolist() == path


def test_gradient_matches_finite_differences():
    chain, index, first, label = random_chain(7)
    g, _ = crf.gradient(chain, index, label, first)
    for part, slope in [(chain.trans, g.trans), (chain.bias, g.bias), (chain.begin, g.begin), *zip(chain.emit, g.emit, strict=True)]:
        for at in np.ndindex(part.shape):
            was, values = part[at], []
            for by in (1e-5, -1e-5):
                part[at] = was + by
                values.append(crf.gradient(chain, index, label, first)[1])
            part[at] = was
            assert np.isclose(slope[at], (values[0] - values[1]) / 2e-5, atol=1e-5)


def test_fit_raises_the_likelihood_and_learns_transitions():
    rng = np.random.default_rng(3)
    label = np.tile([0, 1, 2], 200)  # the words say nothing, the order everything
    first = np.arange(0, 601, 6)
    index = [rng.integers(0, 4, 600)]
    chain = crf.fit(index, label, first, 2, 3, epochs=80)
    value = crf.gradient(chain, index, label, first)[1]
    assert value > 0.1 * 600 * np.log(1 / 3) and (crf.viterbi(chain, chain.scores(index), first) == label).all()


def test_long_sequences_stay_finite():
    chain, _, _, _ = random_chain(1)
    rng = np.random.default_rng(2)
    p, pairs, log_z = crf.expectations(chain, chain.scores([rng.integers(0, 8, 50_000) for _ in range(2)]), np.array([0, 50_000]))
    assert np.isfinite(p).all() and np.isfinite(log_z).all() and np.isclose(pairs.sum(), 49_999)
