"""Small dense linear algebra on cross-products: bases, least squares, two-stage projections."""

from __future__ import annotations

import numpy as np

ROOT_EPS = float(np.sqrt(np.finfo(float).eps))


def basis(gram: np.ndarray, intercept_first: bool = False) -> np.ndarray:
    """Which columns are kept when columns are taken in order and one that the kept ones explain is left out.

    A column counts as explained when what is left of its sum of squares is under max(sum of squares, 1) times the
    root of the machine precision. With an intercept first, the sums of squares are about the mean.
    """
    left = np.array(gram, float)
    limit = np.maximum(np.diag(left), 1.0) * ROOT_EPS
    keep = np.zeros(len(left), bool)
    for j in range(len(left)):
        pivot = left[j, j]
        if abs(pivot) >= limit[j]:
            keep[j] = True
            left = left - np.outer(left[:, j], left[j]) / pivot
        if intercept_first and j == 0:
            limit = np.maximum(np.diag(left), 1.0) * ROOT_EPS
    return keep


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a x = b for a symmetric positive definite a, scaled to a unit diagonal first."""
    if not len(a):
        return np.zeros((0,) + np.shape(b)[1:])
    s = 1 / np.sqrt(np.diag(a))
    scaled = a * np.outer(s, s)
    rhs = (b.T * s).T
    try:
        return (np.linalg.solve(scaled, rhs).T * s).T
    except np.linalg.LinAlgError:
        return (np.linalg.lstsq(scaled, rhs, rcond=None)[0].T * s).T


def inverse(a: np.ndarray) -> np.ndarray:
    out = solve(a, np.eye(len(a)))
    return (out + out.T) / 2


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal factor of a square matrix nearest to it."""
    u, _, v = np.linalg.svd(a)
    return u @ v
