"""Logistic regression on bounded training samples (a few thousand rows)."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50,
              weight: np.ndarray | None = None) -> np.ndarray:
    """Newton steps on rows of ``x`` (a constant column is added last); the weights.

    ``weight``: what each row counts for, relative to the others (default: the same)."""
    c = np.ones(len(x)) if weight is None else weight / weight.mean()
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], l2 * max(1, len(x)) / 100)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(a @ w)
        g = a.T @ (c * (p - y)) + ridge * w
        h = (a * (c * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_sparse(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray,
               l2: float = 1.0, rounds: int = 300, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights of binary features given as (row, column) pairs and scaled per column; bias.

    Adam on the whole sample, loss = log loss with both labels weighing the same in sum
    + l2 / n * |w|^2 / 2."""
    n, d = len(y), len(scale)
    weight = np.where(y > 0.5, 0.5 / max(1.0, y.sum()), 0.5 / max(1.0, (1 - y).sum()))
    w, bias = np.zeros(d), 0.0
    m, v = np.zeros(d + 1), np.zeros(d + 1)
    x = scale[cols]
    for t in range(1, rounds + 1):
        score = np.bincount(rows, weights=x * w[cols], minlength=n) + bias
        err = (sigmoid(score) - y) * weight
        g = np.append(np.bincount(cols, weights=x * err[rows], minlength=d) + l2 / max(1, n) * w,
                      err.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, bias
