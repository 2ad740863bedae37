"""Gradient-boosted trees with monotone constraints, kept as flat node arrays.

Fitting works on a bounded training sample on the driver: features are cut at quantiles, each
split is found in histograms of gradients. Scoring walks all rows through the node arrays at
once, or is written out as a column expression for plans without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF = -1


@dataclass
class Trees:
    feature: np.ndarray  # [trees, nodes], LEAF where the node is a leaf
    threshold: np.ndarray  # a row goes left if its value is at most this
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; nan counts as minus infinity."""
        x = np.where(np.isnan(x), -np.inf, x)
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feature, threshold, left, right, value in zip(
                self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), np.int32)
            while (inner := feature[at] != LEAF).any():
                low = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            out += value[at]
        return out

    def column(self, features: list[Column]) -> Column:
        """The margin as a column expression over numeric features without nulls."""
        def node(tree: int, at: int) -> Column:
            if self.feature[tree][at] == LEAF:
                return F.lit(float(self.value[tree][at]))
            return F.when(
                features[self.feature[tree][at]] <= float(self.threshold[tree][at]),
                node(tree, self.left[tree][at])).otherwise(node(tree, self.right[tree][at]))
        return sum((node(t, 0) for t in range(len(self.feature))), F.lit(self.base))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int] | None = None, rounds: int = 60,
        depth: int = 4, rate: float = 0.15, bins: int = 48, smooth: float = 1.0,
        least: float = 3.0) -> Trees:
    """Boosted trees for log loss. monotone: 1 rising, -1 falling, 0 free for each feature."""
    rows, features = x.shape
    monotone = monotone or [0] * features
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
            if rows else np.zeros(0) for f in range(features)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1) \
        if rows else np.zeros((0, features), int)
    share = np.clip(y.mean() if rows else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    margin, made = np.full(rows, base), []

    def grow(at: np.ndarray, gradient, hessian, level, low, high, nodes) -> int:
        g, h = gradient[at].sum(), hessian[at].sum()
        index = len(nodes)
        nodes.append([LEAF, 0.0, 0, 0, rate * float(np.clip(-g / (h + smooth), low, high))])
        best = (1e-6, -1, -1, 0.0, 0.0)
        if level < depth and h >= 2 * least:
            for f in range(features):
                if not len(cuts[f]):
                    continue
                gl = np.cumsum(np.bincount(binned[at, f], gradient[at], len(cuts[f]) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[at, f], hessian[at], len(cuts[f]) + 1))[:-1]
                gr, hr = g - gl, h - hl
                vl = np.clip(-gl / (hl + smooth), low, high)
                vr = np.clip(-gr / (hr + smooth), low, high)
                gain = (-(gl * vl + (hl + smooth) * vl**2 / 2) - (gr * vr + (hr + smooth) * vr**2 / 2)
                        - g**2 / (h + smooth) / 2)
                ok = (hl >= least) & (hr >= least) & ((vr - vl) * monotone[f] >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, k, vl[k], vr[k])
        _, f, k, vl, vr = best
        if f >= 0:
            middle = (vl + vr) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)),
                      0: ((low, high), (low, high))}[monotone[f]]
            goes = binned[at, f] <= k
            sides = [grow(at[g], gradient, hessian, level + 1, *b, nodes)
                     for g, b in zip((goes, ~goes), bounds, strict=True)]
            nodes[index][:4] = [f, float(cuts[f][k]), *sides]
        return index

    for _ in range(rounds if rows else 0):
        p = 1 / (1 + np.exp(-margin))
        nodes: list[list] = []
        grow(np.arange(rows), p - y, np.maximum(p * (1 - p), 1e-9), 0, -8.0, 8.0, nodes)
        if len(nodes) == 1:
            break
        tree = pack([nodes], 0.0)
        margin += tree.margins(x)
        made.append(nodes)
    return pack(made, base)


def pack(trees: list[list], base: float) -> Trees:
    width = max((len(t) for t in trees), default=1)
    full = [t + [[LEAF, 0.0, 0, 0, 0.0]] * (width - len(t)) for t in trees]
    columns = [np.array([[n[k] for n in t] for t in full]).reshape(len(full), width) for k in range(5)]
    return Trees(columns[0].astype(np.int32), columns[1].astype(float), columns[2].astype(np.int32),
                 columns[3].astype(np.int32), columns[4].astype(float), base)
