"""Sparse linear models in numpy, fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def offsets_of(rows: list[np.ndarray]) -> np.ndarray:
    return np.cumsum([0, *map(len, rows)])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, dim: int, cost: np.ndarray, passes: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """L2-regularised SVM with the linear hinge loss (the dual solver of Hsieh et
    al. 2008): each dual variable lies between 0 and its row's C and is moved to
    its best place in turn. y is -1 or 1, cost a row's C. The bias is a constant
    feature. Rows without features and tied rows are rows like others."""
    w, b = np.zeros(dim), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([v @ v for v in values]) + 1.0
    random = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in random.permutation(len(rows)):
            gradient = y[i] * (values[i] @ w[rows[i]] + b) - 1
            if alpha[i] <= 0 and gradient >= 0 or alpha[i] >= cost[i] and gradient <= 0:
                continue
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            worst = max(worst, abs(gradient))
            alpha[i] = new
            w[rows[i]] += step * values[i]
            b += step
        if worst < 1e-2:
            break
    return w, b


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of the logistic curve 1 / (1 + exp(-(a m + b))) through margins; y is 0 or 1."""
    a, b = 1.0, 0.0
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margin).sum() + 1e-6 * a, g.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
