"""Small models that are fitted on bounded samples: logistic regression and a decision tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Logistic:
    """Logistic regression on standardised features, with an L2 penalty, by Newton steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, weight: np.ndarray | None = None) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        w, each = np.zeros(z.shape[1]), np.ones(len(x)) if weight is None else weight
        ridge = np.r_[np.full(x.shape[1], penalty), 1e-3]
        for _ in range(30):
            p = logistic(z @ w)
            step = np.linalg.solve((z.T * (each * p * (1 - p))) @ z + np.diag(ridge), z.T @ (each * (p - y)) + ridge * w)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, w)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.weights[:-1] + self.weights[-1], -30, 30)

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.margin(x))


@dataclass
class Tree:
    """A binary decision tree; `column` is -1 at a leaf, where `value` is the share of class 1."""

    value: float
    column: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Tree:
        value = float(y.mean())
        if depth == 0 or value in (0.0, 1.0):
            return cls(value)
        best = (value * (1 - value) * len(y) - 1e-9, None)
        for c in range(x.shape[1]):
            known = np.unique(x[:, c])
            for cut in (known[1:] + known[:-1]) / 2:
                low = x[:, c] < cut
                if least <= low.sum() <= len(y) - least:
                    left = sum(s.mean() * (1 - s.mean()) * len(s) for s in (y[low], y[~low]))
                    if left < best[0]:
                        best = (left, (c, float(cut)))
        if best[1] is None:
            return cls(value)
        c, cut = best[1]
        low = x[:, c] < cut
        return cls(value, c, cut, cls.fit(x[low], y[low], depth - 1, least), cls.fit(x[~low], y[~low], depth - 1, least))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.column < 0:
            return np.full(len(x), self.value)
        low = x[:, self.column] < self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out
