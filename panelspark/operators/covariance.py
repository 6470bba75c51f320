"""Covariance estimators: what they need from the rows, and their small-sample scales."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.linear import inverse, polar
from .moments import cross


class Covariance:
    """A covariance estimator. Own estimators give ``meat`` and ``scale``; ``needs_rows`` is False where the residual
    sum of squares is enough."""

    needs_rows = True
    clusters: tuple[str, ...] = ()

    def meat(self, rows: DataFrame, scores: list[Column]) -> tuple[np.ndarray, dict[str, int]]:
        raise NotImplementedError

    def scale(self, n: int, dof: int, counts: dict[str, int]) -> float:
        raise NotImplementedError

    def dof_residual(self, n: int, dof: int, counts: dict[str, int]) -> int:
        return dof


@dataclass(frozen=True)
class Simple(Covariance):
    """Errors of one variance, uncorrelated."""

    needs_rows = False


@dataclass(frozen=True)
class Robust(Covariance):
    """Errors of unlike variances: the sandwich, scaled by n over the degrees of freedom."""

    def meat(self, rows, scores):
        return cross(rows, scores)[0], {}

    def scale(self, n, dof, counts):
        return n / dof


class Cluster(Covariance):
    """Errors correlated within the groups of one or more columns: sums of scores by group, for several columns added
    over all their combinations with alternating signs."""

    def __init__(self, *names: str):
        if not names:
            raise ValueError("name at least one cluster column")
        self.clusters = tuple(dict.fromkeys(names))

    def __repr__(self) -> str:
        return f"Cluster({', '.join(self.clusters)})"

    def meat(self, rows, scores):
        k, m = len(scores), len(self.clusters)
        named = rows.select(*(F.col(f"g_{i}") for i in range(m)), *(s.alias(f"s{j}") for j, s in enumerate(scores)))
        add = lambda df, which: df.groupBy(*(f"g_{i}" for i in which)).agg(*(F.sum(f"s{j}").alias(f"s{j}") for j in range(k)))
        total, counts = np.zeros((k, k)), {}
        # rows are read once, into the finest groups; the coarser ones are sums of those
        finest = add(named, range(m))
        if m > 1:
            finest = finest.persist()
        try:
            for size in range(m, 0, -1):
                for which in combinations(range(m), size):
                    groups = finest if size == m else add(finest, which)
                    part, (count,) = cross(groups, [F.col(f"s{j}") for j in range(k)], extra=[F.count("*")])
                    total += part if size % 2 else -part
                    if size == 1:
                        counts[self.clusters[which[0]]] = count
        finally:
            if m > 1:
                finest.unpersist()
        return total, counts

    def scale(self, n, dof, counts):
        g = min(counts.values())
        return (n - 1) / dof * (g / (g - 1) if g > 1 else np.nan)

    def dof_residual(self, n, dof, counts):
        return min(counts.values())


def rank_wald(pi: np.ndarray, zz: np.ndarray, vv: np.ndarray, variance: np.ndarray) -> float:
    """The Kleibergen-Paap rank statistic of the first stage, for the loss of one rank.

    ``pi`` instruments x endogenous; ``zz`` and ``vv`` cross-products of both sets' residuals; ``variance`` of pi's
    columns set end to end.
    """
    nz, nx = pi.shape
    uz, ux = np.linalg.cholesky(zz).T, np.linalg.cholesky(vv).T
    ux_inv = np.linalg.inv(ux)
    theta = uz @ pi @ ux_inv
    u, _, vt = np.linalg.svd(theta)
    q = nx - 1
    a = u[:, q:] @ polar(u[q:, q:]).T
    b = vt.T[:, q:] @ polar(vt.T[q:, q:]).T
    turn = np.kron(ux_inv.T, uz)
    pick = np.kron(b.T, a.T)
    lam = pick @ theta.flatten(order="F")
    v = pick @ turn @ variance @ turn.T @ pick.T
    return float(lam @ np.linalg.solve(v, lam))


def first_stage_variance(zz: np.ndarray, vv: np.ndarray, meat: np.ndarray | None, scale: float, dof: int) -> np.ndarray:
    """Variance of the first-stage coefficients set end to end: from scores v (x) z, or of one error variance."""
    inv = inverse(zz)
    if meat is None:
        return np.kron(vv / dof, inv)
    spread = np.kron(np.eye(len(vv)), inv)
    return spread @ (meat * scale) @ spread
