"""Which rows an estimation uses."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_condition(df: DataFrame, subset) -> Column:
    """A subset given as a column, a column's name or a SQL condition."""
    if isinstance(subset, str):
        return F.col(f"`{subset}`") if subset in df.columns else F.expr(subset)
    if isinstance(subset, Column):
        return subset
    raise TypeError("subset is a boolean column, a column's name or a SQL condition")


def condition(df: DataFrame, variables: list[str], weights: str | None, subset, clusters: list[str]) -> Column:
    """Complete in all variables, of positive weight, within the subset, with all clusters known.

    Only nulls count as missing. NaN passes here, and is an error later (except for weights, where it is not positive).
    The condition may be null where it is not met, so that all its parts can be pushed to the scan.
    """
    tests = [F.col(f"`{v}`").isNotNull() for v in dict.fromkeys([*variables, *clusters])]
    if weights is not None:
        w = F.col(f"`{weights}`").cast("double")
        tests += [w > 0, ~F.isnan(w)]
    if subset is not None:
        tests.append(as_condition(df, subset).cast("boolean"))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def prune(codes: list[np.ndarray], counts: np.ndarray, rule: str = "fixed_point") -> np.ndarray:
    """Which cells stay when rows that are alone in a group are taken out, again and again.

    ``codes`` has each effect's group of each cell. The default goes on until nothing changes. "compat" visits the
    effects in a circle and stops as soon as all but one visits in a row found nothing, even at the start.
    """
    keep = np.ones(len(counts), bool)
    clean, k, n = 0, 0, len(codes)
    patience = n if rule == "fixed_point" else max(n - 1, 1)
    while n and clean < patience:
        size = np.bincount(codes[k][keep], counts[keep], minlength=int(codes[k].max(initial=-1)) + 1)
        alone = keep & (size[codes[k]] == 1)
        clean = 0 if alone.any() else clean + 1
        keep &= ~alone
        k = (k + 1) % n
        if rule == "fixed_point" and n == 1:
            break
    return keep
