"""A small ridge logistic regression by Newton steps, for calibration and for classifiers over few features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -30, 30)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> Logistic:
    """``x`` (rows, features), ``y`` in 0..1 -> the model; constant features get no weight."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.c_[np.clip((x - mean) / scale, -30, 30), np.ones(len(x))]
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Logistic(mean, scale, w)


def area_under_curve(score: np.ndarray, y: np.ndarray) -> float:
    """Chance that a positive row scores above a negative one, ties counted half; 0.5 without both kinds."""
    y = y.astype(bool)
    pos, neg = np.sort(score[y]), np.sort(score[~y])
    if not len(pos) or not len(neg):
        return 0.5
    below = np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")
    return float(below.sum() / 2 / len(pos) / len(neg))
