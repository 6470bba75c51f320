"""The result of an estimation: statistics on the driver, row-level outputs as lazy DataFrames."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.distributions import f_tail, t_quantile
from .operators.absorb import BROADCAST, Level
from .operators.covariance import Covariance
from .plans import design
from .plans.estimate import Prepared, design_columns
from .plans.formula import INTERCEPT, Formula
from .sources.tables import checkpoint, need_table


@dataclass(frozen=True)
class CoefTable:
    names: list[str]
    columns: list[str]
    values: np.ndarray

    def __str__(self) -> str:
        head = ["", *self.columns]
        body = [[n, *(f"{v:.6g}" for v in row)] for n, row in zip(self.names, self.values, strict=True)]
        wide = [max(len(r[i]) for r in [head, *body]) for i in range(len(head))]
        line = lambda r: r[0].ljust(wide[0]) + "  " + "  ".join(c.rjust(w) for c, w in zip(r[1:], wide[1:], strict=True))
        rule = "-" * len(line(head))
        return "\n".join([rule, line(head), rule, *map(line, body), rule])


def with_keys(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The rows with the key columns under the names that group tables use."""
    return df.select("*", *(F.col(f"`{k}`").alias(f"__{a}") for k, a in keys.items()))


def join_level(df: DataFrame, level: Level, columns: list[Column], tag: str) -> DataFrame:
    """Rows left-joined with a group table; the join never drops or repeats a row, as keys are unique."""
    table = level.table.select(*(F.col(k).alias(f"{tag}{k}") for k in level.keys), *columns, F.lit(True).alias(f"{tag}found"))
    table = F.broadcast(table) if level.groups <= BROADCAST else table
    on = [F.col(f"__{k}") == F.col(f"{tag}{k}") for k in level.keys]
    return df.join(table, on, "left").drop(*(f"{tag}{k}" for k in level.keys))


@dataclass
class Model:
    """A fitted model. Row-level outputs are the rows of the estimation's table with further columns."""

    prepared: Prepared
    levels: list[Level]
    coef: np.ndarray
    vcov: np.ndarray
    coefnames: list[str]
    responsename: str
    vcov_type: Covariance
    beta: dict[int, float]
    facts: dict
    save: str = "none"
    _combos: DataFrame | None = field(default=None, repr=False)

    # ---- what was asked ----
    @property
    def formula(self) -> Formula:
        return self.prepared.formula

    has_iv = property(lambda self: self.formula.has_iv)
    has_fe = property(lambda self: self.formula.has_fe)
    islinear = True

    # ---- statistics ----
    nobs = property(lambda self: self.facts["nobs"])
    dof = property(lambda self: self.facts["dof"])
    dof_fes = property(lambda self: self.facts["dof_fes"])
    dof_residual = property(lambda self: self.facts["dof_residual"])
    rss = property(lambda self: self.facts["rss"])
    tss = property(lambda self: self.facts["tss"])
    deviance = rss
    nulldeviance = tss
    F = property(lambda self: self.facts["F"])
    p = property(lambda self: self.facts["p"])
    F_kp = property(lambda self: self.facts["F_kp"])
    p_kp = property(lambda self: self.facts["p_kp"])
    iterations = property(lambda self: self.facts["iterations"])
    converged = property(lambda self: self.facts["converged"])
    r2_within = property(lambda self: self.facts["r2_within"])
    nclusters = property(lambda self: self.facts["nclusters"])
    n_singletons = property(lambda self: self.facts["n_singletons"])
    has_intercept = property(lambda self: self.facts["has_intercept"])

    @property
    def stderror(self) -> np.ndarray:
        return np.sqrt(np.where(np.diag(self.vcov) >= 0, np.diag(self.vcov), np.nan))

    @property
    def mss(self) -> float:
        return self.tss - self.rss

    def _likelihood(self, squares: float) -> float:
        n = self.nobs
        return -n / 2 * (math.log(2 * math.pi * squares / n) + 1) if squares > 0 else math.inf

    @property
    def loglikelihood(self) -> float:
        return self._likelihood(self.rss)

    @property
    def nullloglikelihood(self) -> float:
        return self._likelihood(self.tss)

    @property
    def nullloglikelihood_within(self) -> float:
        return self._likelihood(self.rss / (1 - self.r2_within)) if self.r2_within < 1 else math.inf

    def _mcfadden(self, taken: int) -> float:
        # the null model of R2 is the one of the constant alone, whatever effects there are
        return 1 - (self.loglikelihood - taken) / self.nullloglikelihood

    def r2(self, variant: str = "devianceratio") -> float:
        if variant == "devianceratio":
            return 1 - self.rss / self.tss if self.tss > 0 else math.nan
        if variant == "McFadden":
            return self._mcfadden(0)
        raise ValueError("variant is devianceratio or McFadden")

    def adjr2(self, variant: str = "devianceratio") -> float:
        k = self.dof + self.dof_fes + self.has_intercept
        if variant == "devianceratio":
            constant = self.has_intercept or self.formula.absorbs_intercept
            return 1 - self.rss * (self.nobs - constant) / (self.tss * max(self.nobs - k, 1))
        if variant == "McFadden":
            return self._mcfadden(k - self.has_intercept - self.has_fe)
        raise ValueError("variant is devianceratio or McFadden")

    def confint(self, level: float = 0.95) -> np.ndarray:
        """A row (low, high) for each coefficient."""
        half = t_quantile(self.dof_residual, 0.5 + level / 2) * self.stderror
        return np.column_stack([self.coef - half, self.coef + half])

    def coeftable(self, level: float = 0.95) -> CoefTable:
        """Estimate, standard error, t, p and confidence bounds; the intercept comes last."""
        t = np.divide(self.coef, self.stderror, out=np.full(len(self.coef), np.nan), where=self.stderror > 0)
        p = [f_tail(1, self.dof_residual, float(x * x)) for x in t]
        values = np.column_stack([self.coef, self.stderror, t, p, self.confint(level)])
        order = sorted(range(len(self.coef)), key=lambda i: self.coefnames[i] == INTERCEPT)
        share = f"{100 * level:g}%"
        return CoefTable([self.coefnames[i] for i in order], ["Estimate", "Std. Error", "t-stat", "Pr(>|t|)", f"Lower {share}", f"Upper {share}"], values[order])

    def coeftable_df(self, spark: SparkSession, level: float = 0.95) -> DataFrame:
        table = self.coeftable(level)
        rows = [(n, *(float(v) for v in row)) for n, row in zip(table.names, table.values, strict=True)]
        return spark.createDataFrame(rows, "term string, estimate double, std_error double, t_stat double, p_value double, conf_low double, conf_high double")

    def __repr__(self) -> str:
        facts = [("Number of obs", self.nobs), ("Converged", self.converged), ("dof (model)", self.dof), ("dof (residuals)", self.dof_residual), ("R2", f"{self.r2():.3f}"), ("R2 adjusted", f"{self.adjr2():.3f}"), ("F-statistic", f"{self.F:.6g}"), ("P-value", f"{self.p:.3f}")]
        if self.has_iv:
            facts += [("F-statistic (first stage)", f"{self.F_kp:.6g}"), ("P-value (first stage)", f"{self.p_kp:.3f}")]
        if self.has_fe:
            facts += [("R2 within", f"{self.r2_within:.3f}"), ("Iterations", self.iterations)]
        shown = [f"{a + ':':<27}{str(b):>12}" for a, b in facts]
        lines = ["   ".join(shown[i : i + 2]) for i in range(0, len(shown), 2)]
        return "\n".join([f"Linear model of {self.formula}", *lines, str(self.coeftable())])

    # ---- rows ----
    def _linear(self, df: DataFrame) -> Column:
        """The regressors times their coefficients on some rows; null where a regressor is."""
        p = self.prepared
        cols = design_columns(df, Formula((), p.formula.exogenous, p.formula.endogenous, (), p.formula.effects, p.formula.intercept, ""), p.levels, p.contrasts, p.functions, p.formula.absorbs_intercept)
        out = F.lit(self._intercept)
        at = len(p.names["y"])
        for e in [*cols["exo"].exprs, *cols["endo"].exprs]:
            # omitted columns count with zero, but a null in them is still a null
            out = out + F.lit(float(self.beta.get(at, 0.0))) * e
            at += 1
        return out

    @property
    def _intercept(self) -> float:
        return float(self.coef[self.coefnames.index(INTERCEPT)]) if INTERCEPT in self.coefnames else 0.0

    def _effect_columns(self) -> list[tuple[Level, int, Column]]:
        """(level table, effect, coefficient) of each effect for what the regressors leave of the response."""
        p, out = self.prepared, []
        y = 0
        one = p.width
        first = next((i for i, e in enumerate(p.formula.effects) if not e.slope), None)
        # the columns were shifted before they were projected; the shift belongs to the first level effect
        moved = float(p.shift[y] - sum(v * p.shift[c] for c, v in self.beta.items() if c < one)) if len(p.shift) else 0.0
        for level in self.levels:
            for e in level.effects:
                theta = F.col(f"t{e}_{y}")
                for c, v in self.beta.items():
                    theta = theta - F.lit(float(v)) * F.col(f"t{e}_{c}")
                out.append((level, e, theta + F.lit(moved) if e == first else theta))
        return sorted(out, key=lambda x: x[1])

    def _with_effects(self, df: DataFrame) -> DataFrame:
        """Rows of any table that has the key columns, with a column __fe{i} for each effect (null where unknown)."""
        out = with_keys(df, self.prepared.keys)
        columns = self._effect_columns()
        for i, level in enumerate(self.levels):
            own = [c.alias(f"__fe{e}") for lv, e, c in columns if lv is level]
            out = join_level(out, level, own, f"__{i}_")
        return out

    def _found(self) -> Column:
        out = F.lit(True)
        for i in range(len(self.levels)):
            out = out & F.coalesce(F.col(f"__{i}_found"), F.lit(False))
        return out

    def _clean(self, df: DataFrame) -> DataFrame:
        return df.drop(*(c for c in df.columns if c.startswith("__") and (c[2:4] == "fe" or c.endswith("found") or c[2:] in self.prepared.keys.values())))

    def esample(self, name: str = "_esample") -> DataFrame:
        """The table with a column that says which rows were used."""
        p = self.prepared
        if not self.levels:
            return p.df.withColumn(name, F.coalesce(p.condition, F.lit(False)))
        return self._clean(self._with_effects(p.df).withColumn(name, F.coalesce(p.condition, F.lit(False)) & self._found()))

    def predict(self, df: DataFrame, name: str = "prediction", per_effect: bool = False) -> DataFrame:
        """The rows of ``df`` with the fitted value, effects included; null where a regressor or key is null or the
        combination of keys was not in the sample (with ``per_effect``: where one of the keys was not)."""
        df = need_table(df)
        if any(e.slope for e in self.formula.effects):
            raise ValueError("predict does not handle effects that are interacted with continuous columns")
        if not self.has_fe:
            return df.withColumn(name, self._linear(df))
        if self.save not in ("fe", "all"):
            raise ValueError("no effects were saved; estimate with save='fe'")
        out = self._with_effects(df)
        known = self._found()
        if len(self.levels) > 1 and not per_effect:
            combos = self._combinations()
            keys = list(self.prepared.keys.values())
            seen = combos.select(*(F.col(k).alias(f"__s{k}") for k in keys), F.lit(True).alias("__seenfound"))
            out = out.join(seen, [F.col(f"__{k}") == F.col(f"__s{k}") for k in keys], "left").drop(*(f"__s{k}" for k in keys))
            known = known & F.coalesce(F.col("__seenfound"), F.lit(False))
        total = self._linear(df)
        for _, e, _ in self._effect_columns():
            total = total + F.col(f"__fe{e}")
        return self._clean(out.withColumn(name, F.when(known, total)))

    def _combinations(self) -> DataFrame:
        if self._combos is None:
            rows = self.prepared.rows
            for level in self.levels:
                table = level.table.select(*level.keys)
                rows = rows.join(F.broadcast(table) if level.groups <= BROADCAST else table, level.keys, "left_semi")
            self._combos = checkpoint(rows.select(*self.prepared.keys.values()).distinct())
        return self._combos

    def residuals(self, df: DataFrame | None = None, name: str = "residual") -> DataFrame:
        """With a table: its rows and response minus prediction (models without effects). Without: the table of the
        estimation with the residuals of its sample, null elsewhere (saved with save='residuals')."""
        p = self.prepared
        if df is not None:
            df = need_table(df)
            if self.has_fe:
                raise ValueError("residuals of a new table are not defined for a model with effects; use residuals()")
            return df.withColumn(name, design._number(df, p.formula.responses[0], p.functions) - self._linear(df))
        if self.save not in ("residuals", "all"):
            raise ValueError("no residuals were saved; estimate with save='residuals'")
        y = design._number(p.df, p.formula.responses[0], p.functions)
        if not self.levels:
            return p.df.withColumn(name, F.when(p.condition, y - self._linear(p.df)))
        out, rest = self._with_effects(p.df), y - self._linear(p.df)
        for _, e, _ in self._effect_columns():
            slope = self.formula.effects[e].slope
            rest = rest - (design.slope(p.df, slope, p.functions) if slope else F.lit(1.0)) * F.col(f"__fe{e}")
        return self._clean(out.withColumn(name, F.when(p.condition & self._found(), rest)))

    def fe(self, keepkeys: bool = False, table: bool = False) -> DataFrame:
        """The estimates of the effects: the estimation's table with a column for each effect (null outside the
        sample). Without ``keepkeys`` only the effects' columns; with ``table`` all columns of the table."""
        if not self.has_fe:
            raise ValueError("the model has no fixed effects")
        if self.save not in ("fe", "all"):
            raise ValueError("no effects were saved; estimate with save='fe'")
        p = self.prepared
        out = self._with_effects(p.df)
        used = p.condition & self._found()
        named = [F.when(used, F.col(f"__fe{i}")).alias(e.name) for i, e in enumerate(self.formula.effects)]
        kept = [F.col(f"`{c}`") for c in p.df.columns] if table else [F.col(f"`{k}`") for k in p.keys] if keepkeys else []
        return out.select(*kept, *named)
