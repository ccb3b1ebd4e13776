"""Logistic regression with follow-the-regularised-leader updates on hashed features."""

from __future__ import annotations

import numpy as np


class Ftrl:
    """Per-coordinate FTRL-proximal; examples are sparse (distinct indices, values)."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def _weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, i: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        w = self._weights(i)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g

    def weights(self) -> np.ndarray:
        return self._weights(slice(None))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
