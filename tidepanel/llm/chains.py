"""Batches of sequences of unequal length, and dynamic programs that run over all of a batch at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Cells of one padded batch.
CELLS = 1_000_000


def padded(sequences: list[np.ndarray], cells: int = CELLS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, lengths, matrix): non-empty sequences by length, padded with 0 to at most ``cells`` cells."""
    lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        own = order[at : at + max(1, min(1024, cells // longest))]
        matrix = np.zeros((len(own), longest), dtype=sequences[own[0]].dtype)
        for row, i in zip(matrix, own.tolist(), strict=True):
            row[: lengths[i]] = sequences[i]
        yield own, lengths[own], matrix
        at += len(own)


def binary_marginals(unary: np.ndarray, lengths: np.ndarray, pair: np.ndarray, joint: np.ndarray | None = None) -> np.ndarray:
    """P(state 1) at each step of two-state chains; to ``joint`` the expected (state, next) counts are added.

    ``unary`` (rows x steps) has the log odds of state 1; ``pair`` (2 x 2) the
    log potentials of (state, next).  Rows come longest first; a message is the
    ratio of its two entries, so nothing under- or overflows.
    """
    rows, steps = unary.shape
    odds = np.exp(np.clip(unary.astype(np.float64), -40, 40)).T.copy()
    e00, e01, e10, e11 = np.exp(pair).ravel()
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")  # rows with a step t
    ahead = np.empty_like(odds)
    r = odds[0].copy()
    ahead[0] = r
    for t in range(1, steps):
        k = live[t]
        x = r[:k]
        r = odds[t, :k] * (e01 + x * e11) / (e00 + x * e10)
        ahead[t, :k] = r
    back = np.ones_like(odds)
    b = np.ones(rows)
    for t in range(steps - 2, -1, -1):
        k = live[t + 1]
        y = b[:k] * odds[t + 1, :k]
        b[:k] = (e10 + y * e11) / (e00 + y * e01)
        back[t, :k] = b[:k]
    if joint is not None:
        for t in range(steps - 1):
            k = live[t + 1]
            a, b = ahead[t, :k], odds[t + 1, :k] * back[t + 1, :k]
            parts = np.stack([np.full(k, e00), e01 * b, e10 * a, e11 * a * b])
            joint += (parts / parts.sum(axis=0)).sum(axis=1).reshape(2, 2)
    both = ahead * back
    return (both / (1 + both)).T


def viterbi(scores: Callable[[int, int], np.ndarray], lengths: np.ndarray, states: int, penalty: float) -> np.ndarray:
    """Best state at each step where changing the state costs ``penalty``.

    ``scores(t, k)`` gives the (k x states) scores of step t for the first k
    rows; rows come longest first.  Ties keep the state, then the first state.
    """
    rows, steps = len(lengths), int(lengths[0])
    live = np.searchsorted(-lengths, -np.arange(steps), side="left")
    came = np.zeros((steps, rows, states), dtype=np.int16)
    own = np.arange(states, dtype=np.int16)
    best = scores(0, rows).astype(np.float64)
    for t in range(1, steps):
        k = live[t]
        was = best[:k]
        top = was.argmax(axis=1)
        enter = was[np.arange(k), top][:, None] - penalty
        stay = was >= enter
        came[t, :k] = np.where(stay, own, top[:, None])
        best[:k] = np.where(stay, was, enter) + scores(t, k)
    path = np.zeros((steps, rows), dtype=np.int16)
    state = best.argmax(axis=1).astype(np.int16)
    for t in range(steps - 1, -1, -1):
        k = live[t]
        path[t, :k] = state[:k]
        if t:
            state[:k] = came[t, np.arange(k), state[:k]]
    return path.T
