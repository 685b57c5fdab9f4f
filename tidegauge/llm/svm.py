"""Linear support vector machines for small training sets, and their calibration."""

from __future__ import annotations

import numpy as np


def fit_linear(x: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 60, weights: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of an L2-regularised squared-hinge SVM by dual coordinate descent; y is -1 or 1.

    Both classes weigh the same in all; ``weights`` scales single rows.
    """
    n = len(x)
    rows = np.ones((n, x.shape[1] + 1), np.float32)
    rows[:, :-1] = x
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * cost * share * (np.ones(n) if weights is None else weights))
    square = np.einsum("ij,ij->i", rows, rows, dtype=np.float64) + diagonal
    alpha, w = np.zeros(n), np.zeros(rows.shape[1], np.float64)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(n):
            slope = y[i] * (w @ rows[i]) - 1 + diagonal[i] * alpha[i]
            step = max(alpha[i] - slope / square[i], 0.0) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * rows[i]
                worst = max(worst, abs(step) * square[i])
        if worst < 1e-3:
            break
    return w


def fit_newton(x: np.ndarray, y: np.ndarray, cost: float = 1.0, weights: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """`fit_linear` for few columns: Newton steps on the primal, with the step halved while it doesn't help."""
    n = len(x)
    rows = np.column_stack([x, np.ones(n)])
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    c = cost * share * (np.ones(n) if weights is None else weights)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        gap = np.maximum(0.0, 1 - y * (rows @ w))
        return 0.5 * w @ w + c @ gap**2, gap

    w = np.zeros(rows.shape[1])
    value, gap = loss(w)
    for _ in range(steps):
        on = gap > 0
        slope = w - 2 * rows[on].T @ (c[on] * y[on] * gap[on])
        curve = np.eye(len(w)) + 2 * (rows[on].T * c[on]) @ rows[on]
        step, size = np.linalg.solve(curve, slope), 1.0
        while True:
            after, gap_after = loss(w - size * step)
            if after <= value or size < 1e-6:
                break
            size /= 2
        gain, w, value, gap = value - after, w - size * step, after, gap_after
        if gain <= 1e-9 * max(1.0, value):
            break
    return w


def fit_sigmoid(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a m + b))) by regularised Newton steps; label is 0 or 1."""
    hi, lo = (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2)
    target = np.where(label > 0, hi, lo)
    scale = max(1e-9, float(np.abs(margin).max(initial=0.0)))
    x = np.column_stack([margin / scale, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - target) + 1e-3 * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w -= step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
