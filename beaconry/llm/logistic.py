"""Small dense logistic regression for bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray | float):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def fit_newton(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, weight: np.ndarray | None = None) -> np.ndarray:
    """Coefficients, the intercept last, by Newton steps; meant for a few features."""
    x = np.column_stack([x, np.ones(len(y))])
    w, sample = np.zeros(x.shape[1]), np.ones(len(y)) if weight is None else weight
    for _ in range(30):
        p = sigmoid(x @ w)
        grad = x.T @ (sample * (p - y)) + l2 * w
        step = np.linalg.solve((x * (sample * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_gradient(x, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 200) -> np.ndarray:
    """Coefficients, the intercept last, by accelerated gradient steps; meant for thousands of scaled features.

    ``x`` has ``shape``, ``dtype``, ``x @ v`` and ``x.back(r)``, the transposed product, so no scaled copy need exist.
    """
    d, kind = x.shape[1], x.dtype
    w, v = np.zeros(d + 1), np.zeros(d + 1)
    norm = weight.sum()
    top = np.ones(d, kind)
    for _ in range(8):  # largest curvature, by power iteration
        top = x.back((weight * (x @ top)).astype(kind)).astype(kind)
        top /= np.linalg.norm(top) + 1e-12
    rate = 1.0 / (0.25 * (float((weight * (x @ top) ** 2).sum()) / norm + 1.0) + l2)
    for k in range(steps):
        p = sigmoid((x @ v[:d].astype(kind)).astype(float) + v[d])
        r = weight * (p - y) / norm
        new = v - rate * np.append(x.back(r.astype(kind)) + l2 * v[:d], r.sum())
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def log_loss(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.average(y * np.log(p) + (1 - y) * np.log(1 - p), weights=weight))
