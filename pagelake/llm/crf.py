"""Linear-chain conditional random fields in numpy: expectations for learning, exact marginals for any length."""

from __future__ import annotations

import numpy as np

CHUNK = 64


def _potentials(emit: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.exp(emit - emit.max(1, keepdims=True)), np.exp(trans - trans.max()), np.exp(start - start.max()),
    )


def _unit(x: np.ndarray, axis) -> np.ndarray:
    return x / np.maximum(x.sum(axis=axis, keepdims=True), 1e-300)


def expectations(emit: np.ndarray, bounds: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label marginals, expected transition counts and expected first labels of sequences; one step per position."""
    E, T, S = _potentials(emit, trans, start)
    lengths = np.diff(bounds)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = bounds[:-1][order], lengths[order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = [int((lengths > t).sum()) for t in range(longest + 1)]
    alpha, gamma = np.zeros_like(E), np.zeros_like(E)
    for t in range(longest):
        k = active[t]
        at = begin[:k] + t
        alpha[at] = _unit((S if t == 0 else alpha[at - 1] @ T) * E[at], 1)
    moves = np.zeros_like(T)
    beta = np.ones((len(begin), E.shape[1]))
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        gamma[at] = _unit(alpha[at] * beta[:k], 1)
        if t:
            ahead = E[at] * beta[:k]
            pair = alpha[at - 1][:, :, None] * T[None] * ahead[:, None, :]
            moves += _unit(pair, (1, 2)).sum(0)
            beta[:k] = _unit(ahead @ T.T, 1)
    return gamma, moves, gamma[begin[: active[0]]].sum(0) if longest else np.zeros(len(S))


def marginals(emit: np.ndarray, bounds: np.ndarray, trans: np.ndarray, start: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Forward-backward marginals. Sequences are cut into chunks whose transfer matrices are multiplied, which is
    exact, so the number of steps follows the chunk and not the longest sequence."""
    n, size = emit.shape
    if not n:
        return np.zeros((0, size))
    E, T, S = _potentials(emit, trans, start)
    lengths = np.diff(bounds)
    pieces = -(-lengths // chunk)
    sequence = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(sequence)) - np.repeat(np.concatenate([[0], np.cumsum(pieces)[:-1]]), pieces)
    begin = bounds[:-1][sequence] + number * chunk
    length = np.minimum(chunk, lengths[sequence] - number * chunk)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    active = [int((length > t).sum()) for t in range(chunk + 1)]
    steps = int(length[0])
    enter = np.repeat(S[None], len(begin), 0)
    leave = np.ones((len(begin), size))
    several = np.flatnonzero(pieces > 1)
    if len(several):
        M = E[begin][:, :, None] * np.eye(size)[None]
        for t in range(1, steps):
            k = active[t]
            M[:k] = (M[:k].reshape(-1, size) @ T).reshape(k, size, size) * E[begin[:k] + t][:, None, :]
            M[:k] /= M[:k].max(axis=(1, 2), keepdims=True)
        first = np.concatenate([[0], np.cumsum(pieces)])[several]
        count = pieces[several]
        by_count = np.argsort(-count, kind="stable")
        first, count = first[by_count], count[by_count]
        most = int(count[0])
        alive = [int((count > c).sum()) for c in range(most + 1)]
        for c in range(1, most):
            k = alive[c]
            before, here = place[first[:k] + c - 1], place[first[:k] + c]
            enter[here] = _unit(np.einsum("ki,kij->kj", enter[before], M[before]) @ T, 1)
        for c in range(most - 1, 0, -1):
            k = alive[c]
            before, here = place[first[:k] + c - 1], place[first[:k] + c]
            leave[before] = _unit(np.einsum("kij,kj->ki", M[here], leave[here]) @ T.T, 1)
    alpha = np.empty_like(E)
    a = enter
    for t in range(steps):
        k = active[t]
        at = begin[:k] + t
        a = _unit((a[:k] if t == 0 else a[:k] @ T) * E[at], 1)
        alpha[at] = a
    b = leave
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        alpha[at] = _unit(alpha[at] * b[:k], 1)
        b[:k] = _unit((E[at] * b[:k]) @ T.T, 1)
    return alpha


class Adam:
    def __init__(self, shapes: list[tuple], rate: float):
        self.m, self.v, self.t, self.rate = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0, rate

    def step(self, values: list[np.ndarray], gradients: list[np.ndarray]) -> None:
        """Moves the values up their gradients, in place."""
        self.t += 1
        for x, g, m, v in zip(values, gradients, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def observed(labels: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-hot labels, transition counts and first labels of labelled sequences."""
    hot = np.eye(size)[labels]
    inner = np.ones(len(labels), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    moves = np.zeros((size, size))
    np.add.at(moves, (labels[at - 1], labels[at]), 1)
    return hot, moves, hot[bounds[:-1]].sum(0)
