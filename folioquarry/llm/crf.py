"""Linear-chain conditional random field over sparse features: training by forward-backward, Viterbi in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """weights: feature x label (the last row, all zero, stands for no feature); step: label x label; first: label."""

    weights: np.ndarray
    step: np.ndarray
    first: np.ndarray

    def emissions(self, active: np.ndarray) -> np.ndarray:
        """Scores of each label for positions with the active feature numbers in each row (-1: none)."""
        out = np.zeros((len(active), self.weights.shape[1]))
        for k in range(active.shape[1]):
            out += self.weights[active[:, k]]
        return out


def train(sequences: list[np.ndarray], labels: list[np.ndarray], n_features: int, n_labels: int, rounds: int = 120, l2: float = 0.02, rate: float = 0.1) -> Crf:
    """Maximum likelihood with an L2 penalty by Adam; the same input gives the same model."""
    n, longest = len(sequences), max(map(len, sequences))
    width = sequences[0].shape[1]
    x = np.full((n, longest, width), n_features, np.int64)
    y = np.zeros((n, longest), np.int64)
    mask = np.zeros((n, longest), bool)
    for i, (s, t) in enumerate(zip(sequences, labels, strict=True)):
        x[i, : len(s)], y[i, : len(s)], mask[i, : len(s)] = np.where(s < 0, n_features, s), t, True
    hot = np.eye(n_labels)[y] * mask[:, :, None]
    both = mask[:, 1:] & mask[:, :-1]
    goal_w = np.zeros((n_features + 1, n_labels))
    for k in range(width):
        np.add.at(goal_w, x[:, :, k].ravel(), hot.reshape(-1, n_labels))
    goal_t = np.einsum("ntj,ntk->jk", hot[:, :-1] * both[:, :, None], hot[:, 1:] * both[:, :, None])
    goal_f = hot[:, 0].sum(0)
    total = mask.sum()
    params = [np.zeros((n_features + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        w, t, f = params
        e = w[x].sum(2)
        p, pair = _marginals(e, t, f, mask, both)
        w_now = np.zeros_like(w)
        for k in range(width):
            np.add.at(w_now, x[:, :, k].ravel(), p.reshape(-1, n_labels))
        grads = [(goal_w - w_now) / total * 10, (goal_t - pair) / total * 10, (goal_f - p[:, 0].sum(0)) / total * 10]
        for i, g in enumerate(grads):
            g = g - l2 * params[i] / 10
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            params[i] = params[i] + rate * (m[i] / (1 - 0.9**r)) / (np.sqrt(v[i] / (1 - 0.99**r)) + 1e-8)
        params[0][-1] = 0
    return Crf(*[np.round(p, 6) for p in params])


def _marginals(e, t, f, mask, both):
    """Marginals of each position, and expected transitions in total."""
    n, longest, k = e.shape
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[:, 0] = f + e[:, 0]
    for i in range(1, longest):
        a[:, i] = np.where(mask[:, i, None], _lse(a[:, i - 1, :, None] + t, 1) + e[:, i], a[:, i - 1])
    for i in range(longest - 2, -1, -1):
        b[:, i] = np.where(both[:, i, None], _lse(t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2), 0)
    z = _lse(a[:, -1], 1)
    p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
    joint = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[:, :, None, None]
    return p, joint.sum((0, 1))


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(model: Crf, emissions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of many sequences at once; sequence i is rows first[i]:first[i + 1].  Ties go to the smaller label.

    Sequences go by falling length, so step t works on all that are longer than t in one array operation.
    """
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    labels = np.zeros(len(emissions), np.int8)
    if not len(order):
        return labels
    begin, sizes = first[:-1][order], sizes[order]
    back = np.zeros(emissions.shape, np.int8)
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # how many are longer than t
    score = model.first + emissions[begin]
    final = score.copy()
    for t in range(1, sizes[0]):
        n = alive[t]
        paths = score[:n, :, None] + model.step
        at = begin[:n] + t
        back[at] = paths.argmax(1)
        score = paths.max(1) + emissions[at]
        final[:n] = score
    now = final.argmax(1).astype(np.int8)
    labels[begin + sizes - 1] = now
    for t in range(sizes[0] - 1, 0, -1):
        n = alive[t]
        at = begin[:n] + t
        labels[at - 1] = back[at, labels[at]]
    return labels
