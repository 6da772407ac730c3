"""Logistic regression on a bounded sample, small enough for the driver."""

from __future__ import annotations

import numpy as np


def fitted(features: np.ndarray, labels: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps on scaled features: rows of (mean, scale, weight), the intercept first."""
    mean, scale = features.mean(0), features.std(0) + 1e-9
    z = np.c_[np.ones(len(features)), (features - mean) / scale]
    w = np.zeros(z.shape[1])
    ridge = penalty * np.eye(len(w))
    ridge[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(z) + ridge, z.T @ (p - labels) / len(z) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return np.c_[np.r_[0.0, mean], np.r_[1.0, scale], w]


def probability(model: np.ndarray, features: np.ndarray) -> np.ndarray:
    z = np.c_[np.ones(len(features)), (features - model[1:, 0]) / model[1:, 1]] @ model[:, 2]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
