"""Linear-chain conditional random field over hashed features.

All steps run over many sequences at once: sequences are ordered by length and
step t handles position t of every sequence that is long enough, so the work is
in proportion to the number of tokens, whatever their lengths.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chain:
    """Emission weights per field (one index column each), transition and start scores."""

    emit: list[np.ndarray]  # each (2 ** bits, K)
    bias: np.ndarray  # (K,)
    trans: np.ndarray  # (K, K)
    begin: np.ndarray  # (K,)
    extra: dict = field(default_factory=dict)

    def scores(self, index: list[np.ndarray]) -> np.ndarray:
        n = len(index[0])
        out = np.broadcast_to(self.bias, (n, len(self.bias))).astype(self.emit[0].dtype if self.emit else np.float32)
        for w, i in zip(self.emit, index, strict=True):
            out += np.take(w, i, axis=0)
        return out


def _steps(first: np.ndarray):
    """Yields (sequences still running, their token index) for t = 0, 1, ..."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    return start, alive


def forward_backward(chain: Chain, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward values a, backward messages m and the log partition function per sequence.

    first: index of the first token of each sequence and the total at the end. a * b is the marginal,
    with b[t] = m[t + 1] @ trans.T inside a sequence and 1 at its end; m[t] = emission * b / scale.
    """
    start, alive = _steps(first)
    top = scores.max(axis=1, keepdims=True)
    e = np.exp(scores - top)
    t_ = np.exp(chain.trans).astype(e.dtype)
    a = np.empty_like(e)
    scale = np.empty((len(e), 1), e.dtype)
    cur = None
    for t, c in enumerate(alive):
        at = start[:c] + t
        x = e[at] * (np.exp(chain.begin).astype(e.dtype) if t == 0 else cur[:c] @ t_)
        scale[at] = x.sum(axis=1, keepdims=True)
        cur = x / scale[at]
        a[at] = cur
    message = e / scale  # right for the last token of a sequence
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        message[at] *= message[at + 1] @ t_.T
    log_z = np.add.reduceat((np.log(scale) + top)[:, 0], first[:-1]) if len(first) > 1 else np.zeros(0)
    return a, message, log_z


def _inner(first: np.ndarray, n: int) -> np.ndarray:
    """Tokens that have a next one in their sequence."""
    inner = np.ones(n, bool)
    inner[first[1:] - 1] = False
    return np.flatnonzero(inner)


def _state_marginals(chain: Chain, a: np.ndarray, message: np.ndarray, first: np.ndarray) -> np.ndarray:
    left = _inner(first, len(a))
    p = a.copy()
    p[left] *= message[left + 1] @ np.exp(chain.trans).astype(a.dtype).T
    return p / p.sum(axis=1, keepdims=True)


def marginals(chain: Chain, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities of each token (n, K) and the log partition function per sequence."""
    a, message, log_z = forward_backward(chain, scores, first)
    return _state_marginals(chain, a, message, first), log_z


def expectations(chain: Chain, scores: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities of each token, expected number of each pair of neighbouring states, log partition functions."""
    a, message, log_z = forward_backward(chain, scores, first)
    left = _inner(first, len(a))
    pairs = (a[left].T.astype(np.float64) @ message[left + 1]) * np.exp(chain.trans)
    return _state_marginals(chain, a, message, first), pairs, log_z


def viterbi(chain: Chain, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best state of each token."""
    start, alive = _steps(first)
    n, k = scores.shape
    back = np.zeros((n, k), np.int8)
    last = np.empty((n, k), scores.dtype)
    cur = None
    trans = chain.trans.astype(scores.dtype)
    for t, c in enumerate(alive):
        at = start[:c] + t
        if t == 0:
            cur = scores[at] + chain.begin.astype(scores.dtype)
        else:
            best = cur[:c, 0, None] + trans[0]
            arg = np.zeros((c, k), np.int8)
            for j in range(1, k):
                other = cur[:c, j, None] + trans[j]
                arg[other > best] = j
                best = np.maximum(best, other)
            back[at] = arg
            cur = best + scores[at]
        last[at] = cur
    state = np.zeros(n, np.int8)
    for t in range(len(alive) - 1, -1, -1):
        c = alive[t]
        at = start[:c] + t
        state[at] = last[at].argmax(axis=1)
        going = alive[t + 1] if t + 1 < len(alive) else 0
        if going:
            state[at[:going]] = back[at[:going] + 1, state[at[:going] + 1]]
    return state


def gradient(chain: Chain, index: list[np.ndarray], label: np.ndarray, first: np.ndarray) -> tuple[Chain, float]:
    """Of the log-likelihood of the labels: its derivative by every score of the chain, and its value."""
    n, k = len(label), len(chain.bias)
    scores = chain.scores(index)
    p, pairs, log_z = expectations(chain, scores, first)
    left = _inner(first, n)
    gold = np.zeros((k, k))
    np.add.at(gold, (label[left], label[left + 1]), 1)
    at = np.arange(n)
    value = scores[at, label].sum(dtype=np.float64) + (gold * chain.trans).sum() + chain.begin[label[first[:-1]]].sum() - log_z.sum(dtype=np.float64)
    d = -p
    d[at, label] += 1
    emit = [np.stack([np.bincount(i, d[:, j], len(w)) for j in range(k)], axis=1) for i, w in zip(index, chain.emit, strict=True)]
    return Chain(emit, d.sum(axis=0, dtype=np.float64), gold - pairs, d[first[:-1]].sum(axis=0, dtype=np.float64)), float(value)


def fit(index: list[np.ndarray], label: np.ndarray, first: np.ndarray, bits: int, k: int, epochs: int = 40, rate: float = 0.5, l2: float = 1e-5) -> Chain:
    """Maximum likelihood, with a small ridge on the emissions, by AdaGrad steps on the exact gradient.

    Each epoch is one step over the whole sample; there is no randomness.
    """
    size, n = 1 << bits, len(label)
    chain = Chain([np.zeros((size, k), np.float32) for _ in index], np.zeros(k), np.zeros((k, k)), np.zeros(k))
    if n == 0:
        return chain
    parts = [*chain.emit, chain.bias, chain.trans, chain.begin]
    memory = [np.full_like(x, 1e-6) for x in parts]
    for _ in range(epochs):
        g, _value = gradient(chain, index, label, first)
        slopes = [x / n - l2 * w for x, w in zip(g.emit, chain.emit, strict=True)] + [g.bias / n, g.trans / n, g.begin / n]
        for x, m, slope in zip(parts, memory, slopes, strict=True):
            m += (slope * slope).astype(m.dtype)
            x += (rate * slope / np.sqrt(m)).astype(x.dtype)
    return chain
