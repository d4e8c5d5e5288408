"""Small learners in numpy, for models of a few kilobytes that are fitted on the driver."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.3) -> np.ndarray:
    """Weights, the constant last, of a logistic regression with a ridge, by Newton's method.

    y may be probabilities; weight says how many rows a row stands for."""
    x = np.c_[x, np.ones(len(x))]
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[-1] = 1e-3
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (weight * (y - p)) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int, tried: int) -> list[tuple]:
    """A classification tree as (feature, cut, left, right, share of ones) rows; feature -1 marks a leaf."""
    tree: list[tuple] = []

    def node(rows: np.ndarray, left_depth: int) -> int:
        me = len(tree)
        share = float(y[rows].mean())
        tree.append((-1, 0.0, 0, 0, share))
        if left_depth == 0 or len(rows) < 2 * least or share in (0.0, 1.0):
            return me
        best = (share * (1 - share) * len(rows) - 1e-9, None)
        for f in rng.choice(x.shape[1], tried, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(rows))
            ok = (v[1:] > v[:-1]) & (n >= least) & (len(rows) - n >= least)
            if not ok.any():
                continue
            a, b = ones[:-1], ones[-1] - ones[:-1]
            impure = np.where(ok, a * (1 - a / n) + b * (1 - b / (len(rows) - n)), np.inf)
            k = int(np.argmin(impure))
            if impure[k] < best[0]:
                best = (impure[k], (int(f), float(v[k] + v[k + 1]) / 2))
        if best[1] is None:
            return me
        f, cut = best[1]
        go = x[rows, f] <= cut
        if go.all() or not go.any():
            return me
        tree[me] = (f, cut, node(rows[go], left_depth - 1), node(rows[~go], left_depth - 1), share)
        return me

    node(np.arange(len(y)), depth)
    return tree


def forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 10, least: int = 3, seed: int = 7) -> list[list[tuple]]:
    """A random forest: each tree on its own bootstrap sample, each split on a random root of the features."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows].astype(float), rng, depth, least, max(1, round(x.shape[1] ** 0.5))))
    return out


def vote(trees: list[list[tuple]], x: np.ndarray) -> np.ndarray:
    """The trees' mean share of ones for each row."""
    total = np.zeros(len(x))
    for tree in trees:
        f, cut, left, right, share = (np.array(c) for c in zip(*tree, strict=True))
        at = np.zeros(len(x), int)
        while (inner := f[at] >= 0).any():
            go = x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at]
            at = np.where(inner, np.where(go, left[at], right[at]), at)
        total += share[at]
    return total / max(1, len(trees))
