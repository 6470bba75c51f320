"""Sums of products of columns, taken where the rows are."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many columns, products are summed by generated code; beyond, batches of rows are multiplied as matrices.
NARROW = 6


def pairs(n: int) -> list[tuple[int, int]]:
    return list(combinations_with_replacement(range(n), 2))


def square(values, n: int) -> np.ndarray:
    """A symmetric matrix from its upper triangle by rows."""
    out = np.zeros((n, n))
    for (i, j), v in zip(pairs(n), values, strict=True):
        out[i, j] = out[j, i] = v
    return out


def cross(df: DataFrame, columns: list[Column], weight: Column | None = None, extra: list[Column] | None = None) -> tuple[np.ndarray, tuple]:
    """The matrix of sums of w * a * b over all pairs of columns, and further aggregates from the same job if the
    columns are few. Nulls must have been filtered out."""
    n, extra = len(columns), extra or []
    named = [c.alias(f"m{i}") for i, c in enumerate(columns)]
    w = [weight.alias("mw")] if weight is not None else []
    if n <= NARROW:
        m = [F.col(f"m{i}") for i in range(n)]
        product = lambda i, j: F.col("mw") * m[i] * m[j] if w else m[i] * m[j]
        got = df.select("*", *named, *w).agg(*(F.coalesce(F.sum(product(i, j)), F.lit(0.0)) for i, j in pairs(n)), *extra).first()
        k = len(pairs(n))
        return square(got[:k], n), tuple(got[k:])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n)])
            total += x.T @ (x * batch.column(n).to_numpy(zero_copy_only=False)[:, None] if w else x)
        i, j = np.triu_indices(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(i)), pa.int64()), pa.array(total[i, j])], names=["k", "v"])

    got = df.select(*named, *w).mapInArrow(sums, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    values = np.zeros(len(pairs(n)))
    for r in got:
        values[r["k"]] = r["v"]
    return square(values, n), tuple(df.agg(*extra).first()) if extra else ()
