"""Forward-backward over many sequences at once, shared by the hidden Markov model and the random field."""

from __future__ import annotations

import numpy as np


def forward_backward(score: np.ndarray, start: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors per position, expected moves, and the log likelihood.

    score: positions x states, positive weights of the observations (any scale per row); start: where each sequence
    starts, one more at the end; first and move: weights of the first state and of moves between states. All sequences
    advance together, longest first, so the loop runs over the longest sequence's length only.
    """
    n, k = score.shape
    size = np.diff(start)
    order = np.argsort(-size, kind="stable")
    at, size = start[:-1][order], size[order]
    alpha, scale = np.empty((n, k)), np.ones(n)
    active = int((size > 0).sum())
    prev = None
    top = int(size[0]) if len(size) else 0
    lasts = np.searchsorted(-size, -np.arange(1, top + 1), "right")
    for t in range(top):
        m = lasts[t]
        i = at[:m] + t
        a = score[i] * (first if t == 0 else prev[:m] @ move)
        c = a.sum(1)
        c[c == 0] = 1e-300
        prev = a / c[:, None]
        alpha[i], scale[i] = prev, c
    post = np.empty((n, k))
    moves = np.zeros((k, k))
    beta = np.ones((active, k))
    for t in range(top - 1, -1, -1):
        m = lasts[t]
        i = at[:m] + t
        post[i] = alpha[i] * beta[:m]
        if t:
            e = score[i] * beta[:m] / scale[i][:, None]
            moves += move * (alpha[i - 1].T @ e)
            beta[:m] = e @ move.T
    total = post.sum(1, keepdims=True)
    total[total == 0] = 1
    return post / total, moves, float(np.log(scale).sum())
