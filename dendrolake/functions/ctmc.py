"""Small dense rate matrices, computed on the driver and used as literals in plans."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def hky(frequencies: Sequence[float], kappa: float) -> np.ndarray:
    """Rate matrix over A, C, G, T: transitions kappa times as fast, one change per unit of time."""
    pi = np.asarray(frequencies, float)
    q = np.tile(pi, (4, 1))
    for a, b in ((0, 2), (1, 3)):
        q[a, b] *= kappa
        q[b, a] *= kappa
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(1))
    return q / -(pi @ np.diag(q))


def eigen_terms(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, values): exp(Q t)[i, j] = [i = j] + sum over k of terms[i, j, k] * expm1(values[k] t)."""
    values, v = np.linalg.eig(q)
    w = np.linalg.inv(v)
    order = np.argsort(values.real)
    return np.real(np.einsum("ik,kj->ijk", v, w))[:, :, order], values.real[order]


def transition(q: np.ndarray, t: float) -> np.ndarray:
    terms, values = eigen_terms(q)
    return np.maximum(0.0, np.eye(len(q)) + terms @ np.expm1(values * t))
