"""Marginals and best labels of chains of two labels, for chains of any length.

A chain is given by the log-odds of label 1 at each of its places and by the log-weights of pairs of labels. Chains are walked place by
place, all at once. A long chain is cut into about as many blocks as a block has places: first each block's effect on any state before
it is worked out, a two-by-two matrix, for all blocks side by side; these are carried from block to block; then all blocks are walked
side by side with the right states at their borders. So a chain of n places takes some four times the root of n steps of numpy, and
beyond the log-odds and the result only some WORK places are held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Places up to which a chain is one block.
CHAIN = 1024

#: Places that are worked on at a time.
WORK = 1 << 18


class _Blocks:
    """The blocks of all chains in order, and groups of them with at most about WORK places."""

    def __init__(self, per_chain: np.ndarray) -> None:
        size = np.where(per_chain <= CHAIN, np.maximum(per_chain, 1), np.ceil(np.sqrt(per_chain)).astype(np.int64))
        counts = -(-per_chain // size)
        self.chain = np.repeat(np.arange(len(per_chain)), counts)
        within = np.arange(len(self.chain)) - np.repeat(np.cumsum(counts) - counts, counts)
        ends = np.cumsum(per_chain)
        self.begins = within == 0
        self.first = (ends - per_chain)[self.chain] + within * size[self.chain]
        self.length = np.minimum(size[self.chain], ends[self.chain] - self.first)
        #: The number of each block that goes on a chain begun by the one before it.
        self.later = np.flatnonzero(~self.begins)

    def groups(self) -> Iterator[tuple[slice, slice, _Walk]]:
        """Blocks, their places, and the walk along them."""
        at = 0
        ends = self.first + self.length
        while at < len(self.first):
            to = max(at + 1, int(np.searchsorted(ends, self.first[at] + WORK, "right")))
            yield slice(at, to), slice(int(self.first[at]), int(ends[to - 1])), _Walk(self.first[at:to] - self.first[at], self.length[at:to])
            at = to


class _Walk:
    """Steps along blocks: at step t, the blocks that have a place t, and these places."""

    def __init__(self, first: np.ndarray, length: np.ndarray) -> None:
        self.order = np.argsort(-length, kind="stable")
        self.begin = first[self.order]
        ordered = length[self.order]
        self.last = self.begin + ordered - 1
        self.longest = int(ordered[0])
        self.active = len(ordered) - np.searchsorted(ordered[::-1], np.arange(self.longest), side="right")

    def rows(self, t: int) -> np.ndarray:
        return self.begin[: self.active[t]] + t


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each vector or matrix divided by its sum."""
    return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)


def marginals(odds: np.ndarray, pairs: np.ndarray, per_chain: np.ndarray) -> np.ndarray:
    """The probability of label 1 at each place."""
    blocks, weights = _Blocks(per_chain), np.exp(pairs)
    n = len(blocks.first)
    ahead, behind = np.ones((n, 2)), np.ones((n, 2))  # states before and after each block
    psi_of = lambda places: np.exp(np.stack([-odds[places] / 2, odds[places] / 2], 1))
    if len(blocks.later):
        effect = np.empty((n, 2, 2))
        for some, places, walk in blocks.groups():
            psi = psi_of(places)
            m = np.where(blocks.begins[some][walk.order][:, None, None], np.ones((2, 2)), weights) * psi[walk.begin][:, None, :]
            for t in range(1, walk.longest):
                rows = walk.rows(t)
                m[: len(rows)] = _scaled((m[: len(rows)] @ weights) * psi[rows][:, None, :])
            effect[np.arange(some.start, some.stop)[walk.order]] = _scaled(m)
        for b in blocks.later.tolist():
            state = ahead[b - 1] @ effect[b - 1]
            ahead[b] = state / state.sum()
        for b in blocks.later[::-1].tolist():
            state = effect[b] @ behind[b]
            behind[b - 1] = state / state.sum()
    out = np.empty(len(odds))
    for some, places, walk in blocks.groups():
        psi = psi_of(places)
        alpha, beta = np.empty_like(psi), np.empty_like(psi)
        start = np.where(blocks.begins[some][walk.order][:, None], 1.0, ahead[some][walk.order] @ weights)
        alpha[walk.begin] = _scaled(start * psi[walk.begin])
        for t in range(1, walk.longest):
            rows = walk.rows(t)
            alpha[rows] = _scaled((alpha[rows - 1] @ weights) * psi[rows])
        beta[walk.last] = behind[some][walk.order]
        for t in range(walk.longest - 1, 0, -1):
            rows = walk.rows(t)
            beta[rows - 1] = _scaled((psi[rows] * beta[rows]) @ weights.T)
        both = alpha * beta
        out[places] = both[:, 1] / both.sum(1)
    return out


def viterbi(odds: np.ndarray, pairs: np.ndarray, per_chain: np.ndarray) -> np.ndarray:
    """The most probable labels of each chain."""
    blocks = _Blocks(per_chain)
    n = len(blocks.first)
    start, end_label = np.zeros((n, 2)), np.zeros(n, np.int8)
    local_of = lambda places: np.stack([-odds[places] / 2, odds[places] / 2], 1)
    if len(blocks.later):
        effect = np.empty((n, 2, 2))
        for some, places, walk in blocks.groups():
            local = local_of(places)
            m = np.where(blocks.begins[some][walk.order][:, None, None], 0.0, pairs) + local[walk.begin][:, None, :]
            for t in range(1, walk.longest):
                rows = walk.rows(t)
                m[: len(rows)] = (m[: len(rows), :, :, None] + pairs).max(2) + local[rows][:, None, :]
            effect[np.arange(some.start, some.stop)[walk.order]] = m
        for b in blocks.later.tolist():
            state = (start[b - 1][:, None] + effect[b - 1]).max(0)
            start[b] = state - state.max()
    back = np.zeros((len(odds), 2), np.int8)
    for some, places, walk in blocks.groups():
        best = local_of(places)
        mine = back[places]
        each = start[some][walk.order][:, :, None] + pairs
        later = ~blocks.begins[some][walk.order]
        mine[walk.begin[later]] = each[later].argmax(1)
        best[walk.begin[later]] += each[later].max(1)
        for t in range(1, walk.longest):
            rows = walk.rows(t)
            each = best[rows - 1][:, :, None] + pairs
            mine[rows] = each.argmax(1)
            best[rows] += each.max(1)
        end_label[np.arange(some.start, some.stop)[walk.order]] = best[walk.last].argmax(1)
    if len(blocks.later):
        # The label before a block, for either label at its end.
        before = np.empty((n, 2), np.int8)
        for some, places, walk in blocks.groups():
            mine, now = back[places], np.tile(np.array([0, 1], np.int8), (some.stop - some.start, 1))
            for t in range(walk.longest - 1, -1, -1):
                rows = walk.rows(t)
                now[: len(rows)] = np.take_along_axis(mine[rows], now[: len(rows)].astype(np.int64), 1)
            before[np.arange(some.start, some.stop)[walk.order]] = now
        for b in blocks.later[::-1].tolist():
            end_label[b - 1] = before[b, end_label[b]]
    labels = np.empty(len(odds), np.int8)
    for some, places, walk in blocks.groups():
        mine, own = back[places], np.empty(places.stop - places.start, np.int8)
        own[walk.last] = end_label[some][walk.order]
        for t in range(walk.longest - 1, 0, -1):
            rows = walk.rows(t)
            own[rows - 1] = mine[rows, own[rows]]
        labels[places] = own
    return labels
