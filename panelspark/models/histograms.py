"""Cuts of tree nodes from histograms of gradients, with L1 and L2 penalties."""

from __future__ import annotations

import numpy as np

BINS = 64


def soft(total, l1):
    """A gradient sum after an L1 penalty."""
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0) if l1 else total


def leaf_value(total, count, l1=0.0, l2=0.0):
    """The step that lowers the loss most where every row has curvature 1."""
    return soft(total, l1) / np.maximum(count + l2, 1e-300)


def choose(count, total, min_rows, min_gain, l1=0.0, l2=0.0, columns=None):
    """The best cut of each node from its rows and gradient sums per column and bin, and what its sides hold.

    Returns whether a node is cut, the column, the last bin of the low side, and (rows, gradient) of either side. The gain is
    the fall of the penalised loss per row; a node whose best gain is no more than ``min_gain`` keeps all rows on its
    low side.
    """
    nodes = len(count)
    count, total = count.cumsum(2), total.cumsum(2)
    whole, sum_ = count[..., -1:], total[..., -1:]

    def score(t, n):
        return soft(t, l1) ** 2 / (np.maximum(n + l2, 1e-300) if l2 else np.maximum(n, 1))

    rest, rest_total = whole - count, sum_ - total
    gain = (score(total, count) + score(rest_total, rest) - score(sum_, whole)) / np.maximum(whole, 1)
    gain = np.where((count >= min_rows) & (rest >= min_rows), gain, -np.inf)
    if columns is not None:
        gain[:, ~columns] = -np.inf
    gain = gain.reshape(nodes, -1)
    best, at = gain.argmax(1), np.arange(nodes)
    useful = gain[at, best] > max(min_gain, 1e-12)
    column, border = best // BINS, best % BINS
    low = np.where(useful, count[at, column, border], whole[:, 0, 0]), np.where(useful, total[at, column, border], sum_[:, 0, 0])
    sides = np.stack([low[0], whole[:, 0, 0] - low[0]], 1).ravel(), np.stack([low[1], sum_[:, 0, 0] - low[1]], 1).ravel()
    return useful, column, border, sides


def descend(bins, cuts):
    """Leaf numbers of the rows after the cuts of some levels."""
    leaf = np.zeros(len(bins), np.int64)
    flat, begin = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
    for useful, column, border in cuts:
        # No bin is above the last one: rows of a node without a cut stay low.
        last = np.where(useful, border, BINS).astype(bins.dtype)
        leaf = 2 * leaf + (flat[begin + column[leaf]] > last[leaf])
    return leaf


def histogram(bins, g, slot, slots):
    """Rows and gradient sums per slot, column and bin; rows of slot -1 do not count."""
    kept = slot >= 0
    bins, g, first = bins[kept], g[kept], slot[kept] * BINS
    rows, total = np.empty((2, slots, bins.shape[1], BINS))
    for i, column in enumerate(bins.T):
        cell = first + column
        rows[:, i] = np.bincount(cell, minlength=slots * BINS).reshape(slots, BINS)
        total[:, i] = np.bincount(cell, g, slots * BINS).reshape(slots, BINS)
    return rows, total


def nodes_of(number, cuts, borders, leaves):
    """Rows of a tree: number, node, feature, border, low, high, value; nodes that are not cut pass rows on to their
    lower side."""
    rows = []
    for level, (useful, column, border) in enumerate(cuts):
        first, below = 2 ** level - 1, 2 ** (level + 1) - 1
        for i, (cut, c, b) in enumerate(zip(useful, column, border)):
            rows.append((number, first + i, int(c) if cut else -1, float(borders[c][b]) if cut else np.nan,
                         below + 2 * i, below + 2 * i + 1, 0.0))
    first = 2 ** len(cuts) - 1
    return rows + [(number, first + i, -1, np.nan, -1, -1, float(leaves.get(i, 0.0))) for i in range(2 ** len(cuts))]
