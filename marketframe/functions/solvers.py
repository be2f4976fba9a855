"""Small dense solvers for Arrow batches: many little systems at once, one per row."""

from __future__ import annotations

import numpy as np


def symmetric(upper: np.ndarray, n: int) -> np.ndarray:
    """Rows of upper triangles to a stack of symmetric matrices."""
    out = np.full((len(upper), n, n), np.nan)
    i, j = np.triu_indices(n)
    out[:, i, j] = upper
    out[:, j, i] = upper
    return out


def equal_risk(cov: np.ndarray, sweeps: int) -> np.ndarray:
    """Equal risk contribution shares per matrix; a missing diagonal leaves the asset out."""
    diagonal = np.diagonal(cov, axis1=1, axis2=2)
    present = np.isfinite(diagonal)
    c = np.where(present[:, :, None] & present[:, None, :], np.nan_to_num(cov), 0.0)
    d = np.where(present, np.maximum(np.nan_to_num(diagonal), 1e-10), 1.0)
    n = np.maximum(present.sum(axis=1), 1)
    x = np.where(present, 1 / np.sqrt(d), 0.0)
    total = np.einsum("ri,rij,rj->r", x, c, x)
    x = x / np.sqrt(np.where(total > 0, total, 1.0))[:, None]
    for _ in range(sweeps):
        for j in range(c.shape[1]):
            others = np.einsum("ri,ri->r", c[:, j, :], x) - d[:, j] * x[:, j]
            root = (np.sqrt(others**2 + 4 * d[:, j] / n) - others) / (2 * d[:, j])
            x[:, j] = np.where(present[:, j], root, 0.0)
    share = x / np.maximum(x.sum(axis=1), 1e-300)[:, None]
    return np.where(present, share, np.nan)


def ridge(gram: np.ndarray, moment: np.ndarray, penalty: float) -> np.ndarray:
    """Coefficients per row; the intercept (first column) is not penalized."""
    k = gram.shape[1]
    weight = np.eye(k) * penalty
    weight[0, 0] = 0.0
    return np.linalg.solve(gram + weight, moment[:, :, None])[:, :, 0]
