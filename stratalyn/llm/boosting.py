"""Gradient-boosted trees small enough to become one Spark expression: fitted in numpy, applied as nested CASEs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    value: float = 0.0
    feature: int = -1
    threshold: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


@dataclass(frozen=True)
class Boosted:
    bias: float
    trees: tuple[Node, ...]
    slope: float  # Platt calibration of the raw score
    offset: float

    def expression(self, features: list[Column]) -> Column:
        """The calibrated probability as a Column."""

        def tree(n: Node) -> Column:
            return F.lit(n.value) if n.low is None else F.when(features[n.feature] <= n.threshold, tree(n.low)).otherwise(tree(n.high))

        raw = F.lit(self.bias)
        for t in self.trees:
            raw = raw + tree(t)
        return 1 / (1 + F.exp(-(self.slope * raw + self.offset)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def one(n: Node, rows: np.ndarray, out: np.ndarray) -> None:
            if n.low is None:
                out[rows] += n.value
            else:
                low = x[rows, n.feature] <= n.threshold
                one(n.low, rows[low], out)
                one(n.high, rows[~low], out)

        raw = np.full(len(x), self.bias)
        for t in self.trees:
            one(t, np.arange(len(x)), raw)
        return 1 / (1 + np.exp(-(self.slope * raw + self.offset)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, rate: float, least: int) -> Node:
    g, h = grad[rows].sum(), hess[rows].sum()
    best, gain = None, 1e-3
    for f in range(x.shape[1]) if depth else ():
        order = rows[np.argsort(x[rows, f], kind="stable")]
        v, cg, ch = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        at = np.flatnonzero(v[:-1] < v[1:])
        at = at[(at + 1 >= least) & (len(rows) - at - 1 >= least)]
        if len(at):
            s = cg[at] ** 2 / (ch[at] + 1) + (g - cg[at]) ** 2 / (h - ch[at] + 1) - g * g / (h + 1)
            if s[k := int(s.argmax())] > gain:
                gain, best = s[k], (f, float((v[at[k]] + v[at[k] + 1]) / 2))
    if best is None:
        return Node(float(rate * g / (h + 1)))
    low = x[rows, best[0]] <= best[1]
    return Node(0.0, *best, _grow(x, grad, hess, rows[low], depth - 1, rate, least), _grow(x, grad, hess, rows[~low], depth - 1, rate, least))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, least: int = 8) -> Boosted:
    """Fit on two thirds of the rows, calibrate on the rest (row order must carry no information)."""
    fold = np.arange(len(y)) % 3 == 0
    prior = float(np.clip(y[~fold].mean(), 1e-3, 1 - 1e-3))
    bias = float(np.log(prior / (1 - prior)))
    raw, grown = np.full(len(y), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        t = _grow(x, y - p, p * (1 - p), np.flatnonzero(~fold), depth, rate, least)
        grown.append(t)
        q = Boosted(0.0, (t,), 1.0, 0.0).predict(x)
        raw = raw + np.log(q / (1 - q))
    slope, offset, r, t = 1.0, 0.0, raw[fold], y[fold]
    for _ in range(50):  # Newton steps with a little shrinkage
        p = 1 / (1 + np.exp(-(slope * r + offset)))
        w = p * (1 - p) + 1e-6
        a = np.array([[np.sum(w * r * r) + 1, np.sum(w * r)], [np.sum(w * r), np.sum(w) + 1]])
        step = np.linalg.solve(a, [np.sum((t - p) * r) + 1 - slope, np.sum(t - p) - offset])
        slope, offset = slope + 0.5 * step[0], offset + 0.5 * step[1]
    return Boosted(bias, tuple(grown), float(slope), float(offset))
