"""A linear-chain conditional random field with two labels over sequences of feature sets, in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """weights: how much each feature speaks for label 1 against label 0; step[i][j]: for label j after label i; first: for label 1 at the start."""

    weights: dict[str, float]
    step: tuple[tuple[float, float], tuple[float, float]]
    first: float
    bias: float

    def unary(self, features: Sequence[str]) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features)

    def decode(self, unary: Sequence[float]) -> list[int]:
        """The likeliest labels (Viterbi); of equally likely ones, label 0."""
        if not unary:
            return []
        (s00, s01), (s10, s11) = self.step
        zero, one = 0.0, self.first + unary[0]
        back: list[tuple[int, int]] = []
        for u in unary[1:]:
            a, b = zero + s00, one + s10
            c, d = zero + s01, one + s11
            back.append((int(b > a), int(d > c)))
            zero, one = max(a, b), max(c, d) + u
        label = int(one > zero)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def train(sequences: Sequence[tuple[Sequence[Sequence[str]], Sequence[int]]], least: int = 5, rounds: int = 200, rate: float = 0.1, decay: float = 0.05, start: bool = False) -> Chain:
    """Maximise the log likelihood less decay/2 times the squared weights; features in under `least` blocks are left out.

    Without start, a chain is as likely to start with either label: where pages start says little about pages cut otherwise.
    """
    counts: dict[str, int] = {}
    for blocks, _ in sequences:
        for block in blocks:
            for f in set(block):
                counts[f] = counts.get(f, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= least))}
    n, length = len(sequences), max(len(b) for b, _ in sequences)
    x = np.zeros((n, length, len(names) + 1))
    y, on = np.zeros((n, length), dtype=np.int64), np.zeros((n, length), dtype=bool)
    for s, (blocks, labels) in enumerate(sequences):
        for t, block in enumerate(blocks):
            x[s, t, [names[f] for f in set(block) if f in names]] = 1
        x[s, : len(blocks), -1] = 1
        y[s, : len(labels)], on[s, : len(labels)] = labels, True
    w = np.zeros(x.shape[2] + 5)  # features and bias, four steps, start
    m, q = np.zeros_like(w), np.zeros_like(w)
    both = on[:, 1:]
    seen = np.bincount((2 * y[:, :-1] + y[:, 1:])[both], minlength=4).astype(float)
    gold = np.concatenate([np.einsum("stf,st->f", x, (y == 1) & on), seen, [float((y[:, 0] == 1).sum())]])
    for k in range(1, rounds + 1):
        u = x @ w[: x.shape[2]]
        step = w[-5:-1].reshape(2, 2)
        node, edge = marginals(u, step, w[-1], on)
        expected = np.concatenate([np.einsum("stf,st->f", x, node), edge.ravel(), [node[:, 0].sum()]])
        g = expected - gold + decay * w
        if not start:
            g[-1] = 0
        m = 0.9 * m + 0.1 * g
        q = 0.99 * q + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(q / (1 - 0.99**k)) + 1e-8)
    s = w[-5:-1]
    return Chain({f: float(w[i]) for f, i in names.items()}, ((float(s[0]), float(s[1])), (float(s[2]), float(s[3]))), float(w[-1]), float(w[len(names)]))


def marginals(u: np.ndarray, step: np.ndarray, first: float, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of label 1 at each place, and the expected number of each step, by forward and backward sums."""
    n, length = u.shape
    score = np.stack([np.zeros_like(u), u], axis=2)
    forward, backward = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    forward[:, 0] = score[:, 0] + np.array([0.0, first])
    for t in range(1, length):
        new = np.logaddexp(forward[:, t - 1, 0, None] + step[0], forward[:, t - 1, 1, None] + step[1]) + score[:, t]
        forward[:, t] = np.where(on[:, t, None], new, forward[:, t - 1])
    for t in range(length - 2, -1, -1):
        after = score[:, t + 1] + backward[:, t + 1]
        new = np.logaddexp(step[:, 0] + after[:, 0, None], step[:, 1] + after[:, 1, None])
        backward[:, t] = np.where(on[:, t + 1, None], new, 0.0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    node = np.exp(forward[:, :, 1] + backward[:, :, 1] - total[:, None]) * on
    pair = forward[:, :-1, :, None] + step + (score + backward)[:, 1:, None, :] - total[:, None, None, None]
    return node, (np.exp(np.where(on[:, 1:, None, None], pair, -np.inf))).sum(axis=(0, 1))
