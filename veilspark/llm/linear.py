"""Logistic regression with ridge penalty, for the bounded samples that classifiers are fitted on."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercept by accelerated gradient steps on the weighted mean loss. y may hold probabilities. With a
    matrix of weights, a column of the results for each of its columns: several fits over the same rows at once."""
    n, d = x.shape
    many = weight if weight.ndim == 2 else weight[:, None]
    share = (many / np.maximum(many.sum(0), 1e-300)).astype(x.dtype)
    target = y.astype(x.dtype)[:, None]
    mean = share.T.astype(float) @ y.astype(float)
    b = np.log((mean + 1e-4) / (1 - mean + 1e-4))
    w = np.zeros((d, many.shape[1]), x.dtype)
    if n and d:
        # the curvature is at most a quarter of the largest eigenvalue of the weighted second moments
        v, most = np.ones(d, x.dtype) / np.sqrt(d), share.max(1)
        for _ in range(12):
            v = x.T @ (most * (x @ v)) + 1e-12
            v /= np.linalg.norm(v) or 1.0
        rate = 1.0 / (0.25 * 1.3 * (float(most @ (x @ v) ** 2) + 1.0) + ridge)
        pw, pb = w, b
        for k in range(steps):
            m = k / (k + 3)
            zw, zb = w + np.asarray(m, x.dtype) * (w - pw), b + m * (b - pb)
            g = share * (sigmoid(x @ zw + zb.astype(x.dtype)) - target)
            pw, pb = w, b
            w, b = (zw - rate * (x.T @ g + ridge * zw)).astype(x.dtype), zb - rate * g.sum(0, dtype=float)
    return (w, b) if weight.ndim == 2 else (w[:, 0], b[0])
