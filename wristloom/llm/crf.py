"""A linear-chain conditional random field: maximum-likelihood training and batched Viterbi, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Crf:
    labels: list[str]
    features: dict[str, int]
    emit: np.ndarray  # features x labels
    move: np.ndarray  # from label x to label
    first: np.ndarray  # label of a sequence's first token

    def scores(self, names: list[str]) -> np.ndarray:
        """The label scores of a token with these features; unknown ones count nothing."""
        return self.emit[[k for n in names if (k := self.features.get(n)) is not None]].sum(axis=0)


def train(sentences: list[list[list[str]]], tags: list[list[str]], labels: list[str], rounds: int = 100, l2: float = 0.02, rate: float = 0.25) -> Crf:
    """Fits sentences (tokens' feature names) to their tags by full-batch Adam on the log likelihood."""
    features = {n: k for k, n in enumerate(sorted({n for s in sentences for t in s for n in t}))}
    where = {x: k for k, x in enumerate(labels)}
    n, longest, width = len(sentences), max(map(len, sentences)), max(len(t) for s in sentences for t in s)
    ids = np.full((n, longest, width), len(features))
    gold = np.zeros((n, longest), dtype=int)
    real = np.zeros((n, longest), dtype=bool)
    for i, (s, t) in enumerate(zip(sentences, tags, strict=True)):
        real[i, : len(s)] = True
        for j, names in enumerate(s):
            ids[i, j, : len(names)] = [features[x] for x in names]
            gold[i, j] = where[t[j]]
    n_labels = len(labels)
    theta = [np.zeros((len(features) + 1, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)]
    m1, m2 = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    flat = ids.reshape(-1)
    onehot = np.eye(n_labels)[gold] * real[..., None]
    for step in range(1, rounds + 1):
        emit, move, first = theta
        score = emit[ids].sum(axis=2)
        forward = np.zeros((n, longest, n_labels))
        backward = np.zeros((n, longest, n_labels))
        forward[:, 0] = first + score[:, 0]
        for j in range(1, longest):
            new = _logsumexp(forward[:, j - 1, :, None] + move, 1) + score[:, j]
            forward[:, j] = np.where(real[:, j, None], new, forward[:, j - 1])
        for j in range(longest - 2, -1, -1):
            new = _logsumexp(move + (score[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(real[:, j + 1, None], new, 0.0)
        total = _logsumexp(forward[:, -1], 1)
        node = np.exp(forward + backward - total[:, None, None]) * real[..., None]
        diff = onehot - node
        g_emit = np.zeros_like(emit)
        for y in range(n_labels):
            g_emit[:, y] = np.bincount(flat, np.repeat(diff[..., y].reshape(-1), width), len(features) + 1)
        g_move = np.zeros_like(move)
        for j in range(1, longest):
            edge = np.exp(forward[:, j - 1, :, None] + move + (score[:, j] + backward[:, j])[:, None, :] - total[:, None, None])
            both = real[:, j, None, None]
            g_move += (onehot[:, j - 1, :, None] * onehot[:, j, None, :] * both - edge * both).sum(axis=0)
        for k, grad in enumerate((g_emit, g_move, diff[:, 0].sum(axis=0))):
            grad = grad / n - l2 / 100 * theta[k]
            m1[k] = 0.9 * m1[k] + 0.1 * grad
            m2[k] = 0.999 * m2[k] + 0.001 * grad**2
            theta[k] = theta[k] + rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        theta[0][-1] = 0  # the padding feature
    return Crf(labels, features, theta[0][:-1], theta[1], theta[2])


def viterbi(scores: list[np.ndarray], labels: list[str], move: np.ndarray, first: np.ndarray, last: np.ndarray, batch_cells: int = 1 << 18) -> list[np.ndarray]:
    """The best labels of sequences of token scores, many at a time, grouped by length.

    first and last are the scores of the first and the last token's label for what stands around.

    A batch holds at most batch_cells tokens, padding included, or one sequence.
    """
    out: list[np.ndarray | None] = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * len(scores[order[stop]]) <= batch_cells:
            stop += 1
        part = order[at:stop][::-1]  # the longest first: those that go on stand in front
        n, lengths = len(part), np.array([len(scores[i]) for i in part])
        longest = int(lengths[0])
        live = np.searchsorted(-lengths, -np.arange(longest), "left")
        grid = np.zeros((longest, n, len(labels)))
        for r, i in enumerate(part):
            grid[: lengths[r], r] = scores[i]
        best = first + grid[0]
        back = np.zeros((longest, n, len(labels)), dtype=np.int8)
        into = np.ascontiguousarray(move.T)  # to label x from label
        for j in range(1, longest):
            m = live[j]
            through = best[:m, None, :] + into
            back[j, :m] = through.argmax(axis=2)
            best[:m] = through.max(axis=2) + grid[j, :m]
        path = np.zeros((longest, n), dtype=np.int8)
        now = (best + last).argmax(axis=1)
        rows = np.arange(n)
        for j in range(longest - 1, -1, -1):
            m = live[j]
            path[j, :m] = now[:m]
            now[:m] = back[j, rows[:m], now[:m]]
        for r, i in enumerate(part):
            out[i] = path[: lengths[r], r]
        at = stop
    return out
