"""Formula terms as named double columns: functions, products, indicator columns of categories."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .formula import FormulaError, Var


@dataclass(frozen=True)
class Dummy:
    """Indicator coding of a column's values; ``base`` is left out where a base is needed (default: the first)."""

    base: object = None


@dataclass(frozen=True)
class Columns:
    names: list[str]
    exprs: list[Column]


#: Values of a category that is a regressor, at most.
MOST = 10_000
NUMERIC = (T.NumericType, T.BooleanType)


def check_types(df: DataFrame, names: list[str]) -> None:
    have = {f.name: f.dataType for f in df.schema}
    for n in names:
        if n not in have:
            raise FormulaError(f"there is no column {n}")
        if not isinstance(have[n], (*NUMERIC, T.StringType, T.DateType)):
            raise TypeError(f"column {n} is of type {have[n].simpleString()}, which a formula cannot use")


def is_category(df: DataFrame, name: str, contrasts: dict) -> bool:
    return name in contrasts or isinstance(df.schema[name].dataType, (T.StringType, T.DateType))


def categories(df: DataFrame, parts, contrasts: dict) -> list[str]:
    """Category columns among the factors of some terms."""
    return list(dict.fromkeys(f.name for p in parts for f in p if isinstance(f, Var) and is_category(df, f.name, contrasts)))


def find_levels(sample: DataFrame, names: list[str]) -> dict[str, list]:
    """The sorted values of each category on the sample. A category is a regressor with a column for each value, so its
    values are few; no more than MOST of them reach the driver, and a mistaken key column is told."""
    out = {}
    for n in names:
        values = [r[0] for r in sample.select(F.col(f"`{n}`")).distinct().limit(MOST + 1).collect()]
        if len(values) > MOST:
            raise FormulaError(f"column {n} has over {MOST} values; absorb it with fe({n})")
        out[n] = sorted(values)
    return out


def _number(df: DataFrame, factor, functions: dict) -> Column:
    if isinstance(factor, Var) and not isinstance(df.schema[factor.name].dataType, NUMERIC):
        raise TypeError(f"column {factor.name} is no number; it is used as a slope or in a function")
    return factor.column(functions).cast("double")


def _indicators(factor: Var, levels: list, contrast: Dummy | None, full: bool) -> list[tuple[str, Column]]:
    base = contrast.base if contrast is not None and contrast.base is not None else (levels[0] if levels else None)
    if not full and levels and base not in levels:
        raise FormulaError(f"{base!r} is no value of {factor.name}")
    c = F.col(f"`{factor.name}`")
    unseen = F.when(c.isNull(), F.lit(None).cast("double")).when(~c.isin(levels), F.raise_error(F.lit(f"{factor.name} has a value that was not in the estimation sample")).cast("double"))
    return [(f"{factor.name}: {v}", unseen.when(c == v, 1.0).otherwise(0.0)) for v in levels if full or v != base]


def expand(df: DataFrame, parts, levels: dict[str, list], contrasts: dict, functions: dict, present: set | None) -> Columns:
    """The columns of some terms.

    A category within a term has a column for each value but the base where the term without the category is in the
    model already (for a lone category: the intercept, absorbed or not), and one for each value otherwise.
    ``present`` holds what is in the model; None turns the rule off: all values then have a column.
    """
    names, exprs = [], []
    for part in parts:
        choices = []
        for k, factor in enumerate(part):
            if isinstance(factor, Var) and factor.name in levels:
                rest = frozenset(part[:k] + part[k + 1 :])
                full = present is None or rest not in present
                choices.append(_indicators(factor, levels[factor.name], contrasts.get(factor.name), full))
            else:
                choices.append([(str(factor), _number(df, factor, functions))])
        if present is not None:
            present.add(frozenset(part))
        # the first factor's values vary fastest
        for combo in product(*reversed(choices)):
            combo = combo[::-1]
            expr = combo[0][1]
            for _, e in combo[1:]:
                expr = expr * e
            names.append(" & ".join(n for n, _ in combo))
            exprs.append(expr)
    return Columns(names, exprs)


def slope(df: DataFrame, factors, functions: dict) -> Column:
    out = F.lit(1.0)
    for f in factors:
        out = out * _number(df, f, functions)
    return out
