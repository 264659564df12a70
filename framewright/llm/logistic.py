"""Sparse logistic regression in numpy, with an optional penalty on differences."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def gram(pairs: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """Mean of the outer products of sparse rows, each (columns, values), with k columns."""
    out = np.zeros((k, k), np.float32)
    for at, v in pairs:
        out[np.ix_(at, at)] += np.outer(v, v)
    return out / len(pairs)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l1: float, pairs: np.ndarray | None = None, pull: float = 0.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """(coefficients, bias) by accelerated proximal gradient descent on the weighted log loss + l1 * |w|_1
    + pull * w @ pairs @ w, with pairs from gram(). The bias is not penalised. Products are in the type of x, so no
    copy of it in another type is made."""
    k = x.shape[1]
    weight = weight / weight.sum()
    over = lambda z: (x @ z[:k].astype(x.dtype)).astype(float) + z[k]
    back = lambda r: np.append((r.astype(x.dtype) @ x).astype(float), r.sum())
    v = np.ones(k + 1)
    for _ in range(20):  # the largest curvature, by power iteration
        v = back(weight * over(v))
        v /= np.linalg.norm(v) or 1.0
    rough = 0.25 * float(v @ back(weight * over(v))) * 1.1 + 1e-9
    if pairs is not None:
        rough += 2 * pull * float(np.trace(pairs))
    w = np.zeros(k + 1)
    z, t = w.copy(), 1.0
    for _ in range(steps):
        g = back(weight * (sigmoid(over(z)) - y))
        if pairs is not None:
            g[:k] += 2 * pull * (pairs @ z[:k].astype(pairs.dtype))
        new = z - g / rough
        new[:k] = np.sign(new[:k]) * np.maximum(0, np.abs(new[:k]) - l1 / rough)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w[:k], float(w[k])
