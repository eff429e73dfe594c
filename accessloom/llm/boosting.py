"""Gradient-boosted trees over binned features, in numpy: logistic loss, histogram splits, fixed depth."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    def __init__(self, edges: list[np.ndarray], trees: list, start: float):
        self.edges, self.trees, self.start = edges, trees, start

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), int)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, out = self.binned(x), np.full(len(x), self.start)
        for feature, cut, leaves in self.trees:
            out += leaves[_leaf(b, feature, cut)]
        return out


def _leaf(b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The leaf of each row: node k of a full tree sends a row to 2k + 1, or 2k + 2 where its bin is beyond the cut."""
    node, rows = np.zeros(len(b), int), np.arange(len(b))
    for _ in range(len(feature).bit_length()):
        node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
    return node - len(feature)


def edges_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bounds of the bins of one feature, its quantiles, from how often each of its values occurs."""
    order = np.argsort(values)
    values, reach = values[order], np.cumsum(counts[order])
    at = np.linspace(0, 1, BINS + 1)[1:-1] * (reach[-1] - 1)
    low = np.floor(at)
    below, above = (values[np.minimum(np.searchsorted(reach, k, "right"), len(values) - 1)] for k in (low, low + 1))
    return np.unique(below + (at - low) * (above - below))


def slopes(model: Boosted, b: np.ndarray, y: np.ndarray, n: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """First and second derivatives of the loss, summed by node of a level, feature and bin, of n rows each of b and y."""
    z, rows = np.full(len(b), model.start), np.arange(len(b))
    for tree in model.trees:
        z += tree[2][_leaf(b, *tree[:2])]
    p = 1 / (1 + np.exp(-z))
    node = np.zeros(len(b), int)
    for _ in range(level):
        node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
    width, columns = BINS + 1, b.shape[1]
    place = ((node - (2 ** level - 1))[:, None] * columns + np.arange(columns)[None, :]) * width + b
    shape = (2 ** level, columns, width)
    return np.stack([np.bincount(place.ravel(), np.repeat(v, columns), np.prod(shape)).reshape(shape) for v in (n * (p - y), n * (p * (1 - p) + 1e-6))])


def grow(edges: list[np.ndarray], share: float, measured, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """measured(model, feature, cut, level): ``slopes`` over all rows, wherever they are; share: of rows that are 1."""
    share = np.clip(share, 1e-3, 1 - 1e-3)
    model, inner = Boosted(edges, [], float(np.log(share / (1 - share)))), 2 ** depth - 1
    for _ in range(trees):
        feature, cut, ends = np.zeros(inner, int), np.full(inner, BINS + 1), []
        for level in range(depth):
            for k, (gs, hs) in enumerate(np.cumsum(measured(model, feature, cut, level), axis=-1).swapaxes(0, 1), 2 ** level - 1):
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
                best = int(np.argmax(gain))
                left = (gt[0, 0], ht[0, 0])
                if gain.flat[best] > 1e-6:
                    feature[k], cut[k] = divmod(best, BINS + 1)
                    left = (gs.flat[best], hs.flat[best])
                if level == depth - 1:
                    ends += [left, (gt[0, 0] - left[0], ht[0, 0] - left[1])]
        g, h = np.array(ends).T
        model.trees.append((feature, cut, -rate * g / (h + ridge)))
    return model


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, edges: list[np.ndarray] | None = None, **options) -> Boosted:
    """Trees from rows in memory, of which each counts n times."""
    n = np.ones(len(x)) if n is None else n
    edges = [edges_of(x[:, j], n) for j in range(x.shape[1])] if edges is None else edges
    b = Boosted(edges, [], 0.0).binned(x)
    return grow(edges, (n * y).sum() / n.sum(), lambda *state: slopes(state[0], b, y, n, *state[1:]), **options)
