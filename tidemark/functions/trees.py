"""Regression trees on binned features in numpy: random forest and gradient boosting. One run's training set is some ten
thousand rows, so a fit is one task; Spark spreads the runs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bins of a feature, and the least gain of a split relative to what the root has to explain.
BINS, LEAST_GAIN = 64, 1e-12


def bin_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature the upper edges of its bins but for the last: between neighbouring values, or quantiles where there are
    more values than bins."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            edges.append(np.unique(np.quantile(column, np.arange(1, bins) / bins)))
        else:
            edges.append((values[1:] + values[:-1]) / 2)
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of the bin of each value; a value on an edge is in the lower one."""
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)


@dataclass
class Tree:
    """Nodes by number, the root 0: feature (-1 in a leaf) and last bin of the left child, children, and value."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gains: np.ndarray

    def predict(self, codes: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        while (inner := self.feature[node] >= 0).any():
            f = self.feature[node]
            to_left = codes[rows, np.maximum(f, 0)] <= self.bin[node]
            node = np.where(inner, np.where(to_left, self.left[node], self.right[node]), node)
        return self.value[node]


def grow(codes: np.ndarray, y: np.ndarray, depth: int, leaf: int, l2: float = 0.0, bins: int = BINS) -> Tree:
    """The tree that splits each node, level by level, where squared error falls most; a child has `leaf` rows or more. Sums
    of all nodes, features and bins of a level come from one histogram. Of equal splits the first feature and bin count."""
    n, k = codes.shape
    cells = codes + np.arange(k) * bins
    feature, cut, left, right, value = ([-1], [0], [0], [0], [y.sum() / (n + l2)])
    gains = np.zeros(k)
    node, rows = np.zeros(n, np.int64), np.arange(n)
    open_nodes = [0]
    least = LEAST_GAIN * max(float((y * y).sum()), 1e-300)
    for _ in range(depth):
        if not open_nodes:
            break
        m = len(open_nodes)
        at = (node[rows][:, None] * (k * bins) + cells[rows]).ravel()
        count = np.bincount(at, minlength=m * k * bins).reshape(m, k, bins).cumsum(axis=2)
        total = np.bincount(at, weights=np.repeat(y[rows], k), minlength=m * k * bins).reshape(m, k, bins).cumsum(axis=2)
        size, whole = count[:, :1, -1:], total[:, :1, -1:]
        fits = (count >= leaf) & (size - count >= leaf)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fits, total**2 / (count + l2) + (whole - total) ** 2 / (size - count + l2) - whole**2 / (size + l2), -np.inf)
        best = gain.reshape(m, -1).argmax(axis=1)
        won = gain.reshape(m, -1)[np.arange(m), best]
        to, next_open, next_rows = np.full((m, 2), -1), [], []
        for i in np.flatnonzero(won > least):
            f, b = divmod(int(best[i]), bins)
            number = open_nodes[i]
            sizes = int(count[i, f, b]), int(size[i, 0, 0] - count[i, f, b])
            sums = float(total[i, f, b]), float(whole[i, 0, 0] - total[i, f, b])
            feature[number], cut[number] = f, b
            gains[f] += won[i]
            for side, (s, t) in enumerate(zip(sizes, sums, strict=True)):
                child = len(feature)
                for held, new in ((feature, -1), (cut, 0), (left, 0), (right, 0), (value, t / (s + l2))):
                    held.append(new)
                (left if side == 0 else right)[number] = child
                if s >= 2 * leaf:
                    to[i, side] = len(next_open)
                    next_open.append(child)
        if not next_open:
            break
        own = node[rows]
        chosen = np.array([feature[j] for j in open_nodes])[own]
        goes_right = codes[rows, np.maximum(chosen, 0)] > np.array([cut[j] for j in open_nodes])[own]
        goes = np.where(chosen >= 0, to[own, goes_right.astype(int)], -1)
        next_rows = rows[goes >= 0]
        node[next_rows] = goes[goes >= 0]
        rows, open_nodes = next_rows, next_open
    return Tree(*(np.array(a) for a in (feature, cut, left, right, value)), gains)


def forest(x: np.ndarray, y: np.ndarray, ask: np.ndarray, seed: int, trees: int = 300, depth: int = 14, leaf: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Mean prediction of trees on rows drawn with replacement, and the share of each feature in what their splits gain."""
    rnd, edges = np.random.default_rng(seed), bin_edges(x)
    codes, asked = binned(x, edges), binned(ask, edges)
    out, shares = np.zeros(len(ask)), np.zeros(x.shape[1])
    for _ in range(trees):
        drawn = rnd.integers(0, len(x), len(x))
        tree = grow(codes[drawn], y[drawn], depth, leaf)
        out += tree.predict(asked)
        shares += tree.gains / max(tree.gains.sum(), 1e-300)
    return out / trees, shares / max(shares.sum(), 1e-300)


def boosting(x: np.ndarray, y: np.ndarray, ask: np.ndarray, seed: int, rounds: int = 400, depth: int = 6, leaf: int = 20, rate: float = 0.06, l2: float = 1.0, patience: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Prediction of trees that each fit what those before leave, shrunk by rate, until the error of a held-out 15 percent
    has not fallen for `patience` rounds; and the share of each feature in the gain."""
    rnd, edges = np.random.default_rng(seed), bin_edges(x)
    order = rnd.permutation(len(x))
    held, kept = order[: len(x) * 15 // 100], order[len(x) * 15 // 100 :]
    codes, asked = binned(x, edges), binned(ask, edges)
    start = y[kept].mean()
    now, out, shares = np.full(len(x), start), np.full(len(ask), start), np.zeros(x.shape[1])
    best, since = np.inf, 0
    for _ in range(rounds):
        tree = grow(codes[kept], (y - now)[kept], depth, leaf, l2)
        now += rate * tree.predict(codes)
        out += rate * tree.predict(asked)
        shares += tree.gains
        error = float(((y - now)[held] ** 2).mean()) if len(held) else 0.0
        if error < best - 1e-7:
            best, since = error, 0
        elif (since := since + 1) >= patience:
            break
    return out, shares / max(shares.sum(), 1e-300)
