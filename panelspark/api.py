"""The public verbs: reg (fit) and partial_out."""

from __future__ import annotations

import logging
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Model, join_level, with_keys
from .operators.covariance import Covariance, Simple
from .plans import design, estimate
from .plans.formula import INTERCEPT, parse
from .sources.tables import need_table

log = logging.getLogger("panelspark")
METHODS = ("cpu", "gpu", "CUDA", "Metal")


def _ignored(method: str, nthreads, double_precision, progress_bar) -> None:
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}")
    if method != "cpu":
        log.warning("method=%s is accepted and ignored: the executors do the work", method)
    if nthreads is not None:
        log.warning("nthreads is deprecated and ignored: parallelism is Spark's")
    if double_precision is False:
        log.info("double_precision=False is ignored: sums are in double precision")


def reg(
    df: DataFrame,
    formula,
    vcov: Covariance | None = None,
    *,
    contrasts: dict | None = None,
    weights: str | None = None,
    save: str | bool = "none",
    method: str = "cpu",
    nthreads: int | None = None,
    double_precision: bool | None = None,
    tol: float = 1e-6,
    maxiter: int = 10_000,
    drop_singletons: bool = True,
    progress_bar: bool = True,
    subset: Column | str | None = None,
    first_stage: bool = True,
    functions: dict | None = None,
    singletons: str = "fixed_point",
) -> Model:
    """Estimates a linear model, with absorbed effects and instruments where the formula has them.

    df           a DataFrame
    formula      text such as "y ~ x + fe(g) + (endo ~ inst)", or a Formula
    vcov         Simple() (default), Robust(), Cluster("a", ...), or an own Covariance
    contrasts    numeric columns to take as categories, or bases: {"year": Dummy(base=80)}
    weights      a column; rows where it is not positive are left out
    save         "none", "residuals", "fe" or "all" (True/False: all/none): what row-level outputs are wanted
    tol, maxiter tolerance and iterations of the projection; tol also tells columns that the effects explain
    drop_singletons  leave out rows that are alone in a group, again until none is
    subset       a boolean column or SQL condition
    first_stage  whether to test the instruments
    functions    further functions that the formula names, of columns
    singletons   "fixed_point" or "compat" (an earlier stop, see README)
    """
    df, f = need_table(df), parse(formula)
    _ignored(method, nthreads, double_precision, progress_bar)
    save = {True: "all", False: "none"}.get(save, save) if isinstance(save, bool) else save
    if save not in ("all", "none", "residuals", "fe"):
        raise ValueError("save is one of all, none, residuals, fe")
    if len(f.responses) != 1:
        raise ValueError("reg takes one response; partial_out takes several")
    vcov = vcov if vcov is not None else Simple()
    p = estimate.prepare(df, f, weights, subset, vcov.clusters, contrasts, functions)
    s = estimate.sums(p, tol, maxiter, drop_singletons, singletons)
    fit = estimate.estimate(p, s, vcov, tol, first_stage)
    names = _names(p)
    first = len(p.names["y"])
    shown = ([-1] if p.intercept else []) + list(range(first, first + len(p.names["exo"]) + len(p.names["endo"])))
    place = {c if c != p.width else -1: i for i, c in enumerate(fit.order)}
    coef, matrix = np.zeros(len(shown)), np.full((len(shown), len(shown)), np.nan)
    for i, a in enumerate(shown):
        if a in place:
            coef[i] = fit.coef[place[a]]
            for j, b in enumerate(shown):
                if b in place:
                    matrix[i, j] = fit.vcov[place[a], place[b]]
    levels = s.projection.levels if s.projection else []
    return Model(p, levels, coef, matrix, [INTERCEPT if c == -1 else names[c] for c in shown], names[0], vcov, fit.beta, fit.facts, save)


fit = reg


def _names(p: estimate.Prepared) -> list[str]:
    return [n for b in p.names.values() for n in b]


@dataclass(frozen=True)
class PartialOut:
    """Residualised columns: the table's rows with resid_<response> (null outside the sample), and facts of the fit."""

    df: DataFrame
    esample: DataFrame
    iterations: list[int]
    converged: list[bool]
    dof_fes: int


def partial_out(
    df: DataFrame,
    formula,
    *,
    weights: str | None = None,
    add_mean: bool = False,
    maxiter: int = 10_000,
    contrasts: dict | None = None,
    method: str = "cpu",
    double_precision: bool = True,
    tol: float | None = None,
    align: bool = True,
    drop_singletons: bool = False,
    functions: dict | None = None,
) -> PartialOut:
    """Residuals of one or more responses on regressors and effects: "y1 + y2 ~ x + fe(g)".

    add_mean adds each response's (weighted) mean back; align keeps all rows of the table, otherwise only the sample's.
    """
    df, f = need_table(df), parse(formula)
    _ignored(method, None, double_precision, False)
    if f.has_iv:
        raise ValueError("partial_out does not take instruments")
    tol = tol if tol is not None else 1e-8 if double_precision else 1e-6
    p = estimate.prepare(df, f, weights, None, (), contrasts, functions)
    s = estimate.sums(p, tol, maxiter, drop_singletons, "fixed_point")
    g, explicit = estimate.gram_with_intercept(p, s)
    ys = list(range(len(p.names["y"])))
    xs = [len(ys) + i for i in range(len(p.names["exo"]))] + ([p.width] if explicit else [])
    b = np.linalg.lstsq(g[np.ix_(xs, xs)], g[np.ix_(xs, ys)], rcond=1e-12)[0] if xs else np.zeros((0, len(ys)))
    cols = estimate.design_columns(df, f, p.levels, p.contrasts, p.functions, f.absorbs_intercept)
    levels = s.projection.levels if s.projection else []
    out = with_keys(df, p.keys)
    centre = s.mean + p.shift if p.intercept and not f.effects else p.shift
    for i, level in enumerate(levels):
        own = [(F.col(f"t{e}_{y}") - sum((F.lit(float(b[k, y])) * F.col(f"t{e}_{x}") for k, x in enumerate(xs)), F.lit(0.0))).alias(f"__fe{e}_{y}") for e in level.effects for y in ys]
        out = join_level(out, level, own, f"__{i}_")
    used = F.coalesce(p.condition, F.lit(False))
    for i in range(len(levels)):
        used = used & F.coalesce(F.col(f"__{i}_found"), F.lit(False))
    named = []
    for y in ys:
        r = cols["y"].exprs[y] - float(centre[y])
        for k, x in enumerate(xs):
            value = (cols["exo"].exprs[x - len(ys)] - float(centre[x])) if x < p.width else F.lit(1.0)
            r = r - F.lit(float(b[k, y])) * value
        for e, effect in enumerate(f.effects):
            r = r - (design.slope(df, effect.slope, p.functions) if effect.slope else F.lit(1.0)) * F.col(f"__fe{e}_{y}")
        mean = float(s.mean[y] + p.shift[y]) if add_mean else 0.0
        named.append(F.when(used, r + mean).alias(f"resid_{p.names['y'][y]}"))
    every = [F.col(f"`{c}`") for c in df.columns]
    rows = out if align else out.where(used)
    counts = s.projection.iterations[: p.width] if s.projection else [0] * p.width
    done = s.projection.converged if s.projection else True
    return PartialOut(rows.select(*every, *named), out.select(*every, used.alias("_esample")), counts, [done] * p.width, sum(s.projection.groups) if s.projection else 0)
