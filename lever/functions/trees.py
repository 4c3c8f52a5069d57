"""Regression trees on binned features, grown level by level from histograms.

Several trees grow at once, a grove: their nodes share arrays, so a level is a few
array operations whatever the number of trees.  A level needs two sums for each open node, feature and bin: the weights and the
weighted targets.  Targets are integers (:func:`as_integers`) and every sum is exact,
so histograms of parts of the rows add up to just what one part would have given:
a tree does not depend on how rows are spread over tasks.
"""

from __future__ import annotations

import numpy as np

TARGET_BITS = 26
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Poisson(1) up to where its tail is below 2**-53
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, i + 1)) for i in range(19)])


def bootstrap(draws: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row (by its hash) is drawn for a tree: Poisson(1), as drawing n of n with replacement nearly is."""
    with np.errstate(over="ignore"):
        salt = mixed(np.array([seed], np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + _U(tree + 1))
        u = (mixed(draws.view(_U) ^ salt) >> _U(11)).astype(float) * 2.0 ** -53
    return np.searchsorted(POISSON, u, "right").astype(float)


def as_integers(y: np.ndarray, low: float, high: float) -> np.ndarray:
    """Targets on a grid of 2**27 steps over [low, high], about its middle, as whole doubles."""
    half = (high - low) / 2
    return np.rint((y - (low + half)) / half * 2.0 ** TARGET_BITS) if half > 0 else np.zeros(len(y))


def from_integers(v: np.ndarray, low: float, high: float) -> np.ndarray:
    half = (high - low) / 2
    return v * 2.0 ** -TARGET_BITS * half + (low + half)


class Grove:
    """Trees in arrays; node r is the root of tree r.  ``left`` is a node's first child (the second follows it) or -1;
    ``open`` lists the nodes that the next level may split, and says nothing once growth has ended."""

    FIELDS = ("tree", "feature", "cut", "left", "value", "gain", "open")

    def __init__(self, tree, feature, cut, left, value, gain, open):
        self.tree, self.feature, self.cut, self.left, self.open = (np.array(a, np.int64) for a in (tree, feature, cut, left, open))
        self.value, self.gain = np.array(value, float), np.array(gain, float)

    @classmethod
    def planted(cls, trees: int) -> "Grove":
        blank = np.full(trees, -1)
        return cls(np.arange(trees), blank, blank, blank, np.zeros(trees), np.zeros(trees), np.arange(trees))

    def step(self, bins: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One level down from the nodes ``at`` of ``rows``; rows in leaves stay."""
        inner = self.left[at] >= 0
        node = at[inner]
        right = bins[self.feature[node], rows[inner]] > self.cut[node]
        out = at.copy()
        out[inner] = self.left[node] + right
        return out

    def leaves(self, bins: np.ndarray, rows: np.ndarray, trees: np.ndarray) -> np.ndarray:
        """The node so far of each row in its tree."""
        at = trees
        while True:
            new = self.step(bins, rows, at)
            if np.array_equal(new, at):
                return at
            at = new

    def histograms(self, bins, n_bins, rows, at, weight, target) -> np.ndarray:
        """(2, open nodes, features, bins): weights and weighted targets of the rows in open nodes."""
        place = np.full(len(self.left), -1, np.int64)
        place[self.open] = np.arange(len(self.open))
        node = place[at]
        keep = node >= 0
        rows, node, weight = rows[keep], node[keep] * n_bins, weight[keep]
        both = weight * target[rows]
        out = np.zeros((2, len(self.open), len(bins), n_bins))
        size = len(self.open) * n_bins
        for j in range(len(bins)):
            key = node + bins[j, rows]
            out[0, :, j] = np.bincount(key, weight, size).reshape(-1, n_bins)
            out[1, :, j] = np.bincount(key, both, size).reshape(-1, n_bins)
        return out

    def split(self, sums: np.ndarray) -> None:
        """Split the open nodes by their :meth:`histograms`."""
        features, n_bins = sums.shape[2:]
        flat_w, flat_s = sums.reshape(2, -1)
        cell = np.flatnonzero(flat_w != 0)
        self.split_cells(cell, flat_w[cell], flat_s[cell], np.arange(features) * n_bins, features * n_bins)

    def split_cells(self, cell, w, s, first, size) -> None:
        """Split the open nodes where the squared error falls most; of equal gains the first feature and cut.

        A node has ``size`` cells, those of feature j from ``first[j]`` on, one a bin; ``cell`` are the ones that hold
        rows, in order, ``w`` and ``s`` their weights and weighted targets.  So small nodes cost what their rows cost."""
        if not len(cell):
            self.open = self.open[:0]
            return
        features = len(first)
        of = np.repeat(np.arange(features), np.diff(first, append=size))
        node = cell // size
        code = cell - node * size
        group = node * features + of[code]  # a node's feature
        same = group[1:] == group[:-1]
        ends = np.flatnonzero(np.append(~same, True))
        cw, cs = np.cumsum(w), np.cumsum(s)
        before_w, before_s = (np.append(0.0, c[ends[:-1]]) for c in (cw, cs))
        n, total = cw[ends] - before_w, cs[ends] - before_s
        if (self.left < 0).all():
            roots, at = np.unique(node[ends], return_index=True)
            self.value[self.open[roots]] = total[at] / n[at]
        inner = np.flatnonzero(same)  # a cut after the last bin parts nothing
        own = np.cumsum(np.append(0, ~same))[inner]
        w, s, n, total = cw[inner] - before_w[own], cs[inner] - before_s[own], n[own], total[own]
        rest = n - w
        a, b = s / w, (total - s) / rest
        apart = np.abs(a - b)
        apart[apart <= 1e-12 * (np.abs(a) + np.abs(b))] = 0
        gain = w * rest / n * apart ** 2
        node = node[inner]
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        best = np.maximum.reduceat(gain, start) if len(start) else gain
        top = np.flatnonzero((gain == np.repeat(best, np.diff(start, append=len(node)))) & (gain > 0))
        at = top[np.append(True, node[top[1:]] != node[top[:-1]])[:len(top)]]
        code = code[inner[at]]
        self._grow(self.open[node[at]], of[code], code - first[of[code]], gain[at],
                   np.stack([a[at], b[at]], axis=1).reshape(-1), np.stack([w[at], rest[at]], axis=1).reshape(-1))

    def _grow(self, node, feature, cut, gain, values, weights) -> None:
        """Give each ``node`` two children, with their ``values`` and ``weights``."""
        first, size = len(self.left), len(values)
        self.feature[node], self.cut[node], self.gain[node] = feature, cut, gain
        self.left[node] = first + 2 * np.arange(len(node))
        blank = np.full(size, -1, np.int64)
        self.feature, self.cut, self.left = (np.append(x, blank) for x in (self.feature, self.cut, self.left))
        self.tree = np.append(self.tree, np.repeat(self.tree[node], 2))
        self.value, self.gain = np.append(self.value, values), np.append(self.gain, np.zeros(size))
        self.open = first + np.flatnonzero(weights > 1)

    def importances(self, n_features: int) -> np.ndarray:
        """Per tree and feature the share of the fall of the squared error; zeros for a tree without a split."""
        inner, trees = self.left >= 0, int(self.tree.max()) + 1
        total = np.bincount(self.tree[inner] * n_features + self.feature[inner], self.gain[inner], trees * n_features) \
            .reshape(trees, n_features)
        whole = total.sum(axis=1, keepdims=True)
        return total / np.where(whole > 0, whole, 1)


def pairs(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trees, rows, weights) where a tree has drawn a row, of (trees, rows) weights."""
    tree, row = np.nonzero(weights)
    return tree, row, weights[tree, row]


#: Weight of a tree's rows up to which a weight and a weighted target share one exact double.
_SHARED = 1 << 12


def grown(bins, n_bins, target, weights, depth: int) -> Grove:
    """A tree for each of the (trees, rows) ``weights``, up to ``depth`` levels."""
    grove = Grove.planted(len(weights))
    at, rows, weight = pairs(weights)
    heaviest = weights.sum(axis=1).max(initial=0)
    small = heaviest <= _SHARED
    if small:  # one sum a cell, of weight * unit + weighted target, and no cells for bins that no row has
        unit = 2.0 ** (TARGET_BITS + 1 + int(np.ceil(np.log2(heaviest + 1))))
        sizes = bins.max(axis=1, initial=0).astype(np.int64) + 1
        first, size = np.cumsum(sizes) - sizes, int(sizes.sum())
        codes = bins + first[:, None]
        both = target + unit
    for _ in range(depth):
        if small:
            place = np.zeros(len(grove.left), np.int64)
            place[grove.open] = np.arange(len(grove.open)) * size
            key = codes[:, rows]
            key += place[at]
            sums = np.bincount(key.reshape(-1), np.tile(weight * both[rows], len(bins)), len(grove.open) * size)
            cell = np.flatnonzero(sums != 0)
            sums = sums[cell]
            w = np.rint(sums / unit)
            grove.split_cells(cell, w, sums - w * unit, first, size)
        else:
            grove.split(grove.histograms(bins, n_bins, rows, at, weight, target))
        if not len(grove.open):
            break
        at = grove.step(bins, rows, at)
        growing = np.zeros(len(grove.left), bool)
        growing[grove.open] = True
        inside = growing[at]  # rows in leaves are done
        rows, at, weight = rows[inside], at[inside], weight[inside]
    return grove
