"""Sparse logistic regression by follow-the-regularised-leader (proximal) with elastic-net penalties.

Weights of a feature are a function of its accumulators z and n, so that a rarely seen feature stays
exactly zero (the L1 part) and each coordinate has its own step. Binary and multinomial (softmax) losses.
"""

from __future__ import annotations

import numpy as np


class Ftrl:
    def __init__(self, dims: int, classes: int, alpha=0.3, beta=1.0, l1=0.02, l2=0.001):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, x: np.ndarray, target: np.ndarray, weight: float = 1.0) -> None:
        """One example: features `at` (distinct) with values x; target: the classes' probabilities."""
        w = self.weights(at)
        p = softmax(x @ w)
        g = weight * x[:, None] * (p - target)[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, weights: np.ndarray | None = None, seed: int = 7) -> None:
        eye, order = np.eye(self.z.shape[1]), np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                self.update(*rows[i], eye[labels[i]], 1.0 if weights is None else weights[i])


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least log loss on rows that the fit did not see."""
    if not len(logits):
        return 1.0

    def loss(t):
        p = softmax(logits / t)
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    grid = np.exp(np.linspace(np.log(0.2), np.log(20), 93))
    return float(min(grid, key=loss))
