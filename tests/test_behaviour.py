"""Types, options and equivalences."""

import datetime
import decimal
import logging

import numpy as np
import pandas as pd
import pytest

from panelspark import Cluster, Covariance, Robust, Simple, fit, reg
from panelspark.operators.moments import cross

from test_against_dense import panel


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(panel(3, 500)).repartition(3).cache()


class Plain(Covariance):
    """An estimator of our own: the sandwich without a scale."""

    def meat(self, rows, scores):
        return cross(rows, scores)[0], {}

    def scale(self, n, dof, counts):
        return 1.0


def test_own_covariance(df):
    a, b = reg(df, "y ~ x + fe(h)", Plain()), reg(df, "y ~ x + fe(h)", Robust())
    n, k = b.nobs, 1 + b.dof_fes
    assert np.allclose(a.stderror, b.stderror * np.sqrt((n - k) / n))


def test_equivalent_formulas(df):
    a, b = reg(df, "y ~ x + fe(h)&v", save="all"), reg(df, "y ~ x + v&fe(h)")
    assert np.allclose(a.coef, b.coef) and np.allclose(a.vcov, b.vcov)
    assert np.allclose(reg(df, "y ~ x + fe(h) + fe(h)*v").coef, reg(df, "y ~ x + fe(h)*v").coef)
    assert np.allclose(reg(df, "y ~ e + x").coef[[0, 2, 1]], reg(df, "y ~ x + e").coef)
    assert np.allclose(reg(df, "y ~ 1 + x + fe(h)").coef, reg(df, "y ~ x + fe(h)").coef)
    c = fit(df, "y ~ x + fe(h)&v", Simple(), save=True)
    assert np.allclose(a.coef, c.coef) and a.rss == pytest.approx(c.rss)


def test_saving_changes_no_statistic(df):
    for kind in ("none", "residuals", "fe", "all"):
        m = reg(df, "y ~ x + fe(g) + fe(h)", Robust(), save=kind)
        assert m.rss == pytest.approx(reg(df, "y ~ x + fe(g) + fe(h)", Robust()).rss, rel=1e-12)


def test_key_and_regressor_types(spark):
    rng = np.random.default_rng(1)
    n = 120
    rows = [(float(y), bool(b), int(i), decimal.Decimal(str(round(d, 2))), datetime.date(2020, 1, 1 + int(k)), f"k{k}") for y, b, i, d, k in zip(rng.normal(size=n), rng.integers(0, 2, n), rng.integers(0, 9, n), rng.normal(size=n), rng.integers(0, 4, n), strict=True)]
    df = spark.createDataFrame(rows, "y double, b boolean, i int, d decimal(10,2), day date, s string")
    pdf = pd.DataFrame(rows, columns="y b i d day s".split())
    x = np.column_stack([np.ones(n), pdf.b.astype(float), pdf.i, pdf.d.astype(float)])
    assert np.allclose(reg(df, "y ~ b + i + d").coef, np.linalg.lstsq(x, pdf.y.to_numpy(), rcond=None)[0])
    by = reg(df, "y ~ i + fe(s)").coef
    for key in ("day",):
        assert np.allclose(reg(df, f"y ~ i + fe({key})").coef, by)
    m = reg(df, "y ~ i + fe(b) + fe(day)", save="all")
    assert m.dof_fes == 6 and m.predict(df).where("prediction is null").count() == 0
    assert reg(df, "y ~ day").coefnames[1] == "day: 2020-01-02"
    m = reg(df, "y ~ i&s + fe(b)", Cluster("day", "b"))
    assert len(m.coef) == 4 and m.nclusters == {"day": 4, "b": 2}


def test_nested_and_duplicate_effects(df):
    wide = df.selectExpr("*", "g % 2 = 0 as even", "g as g2")
    one = reg(wide, "y ~ x + fe(g)")
    for f in ("y ~ x + fe(g) + fe(even)", "y ~ x + fe(g) + fe(g2)", "y ~ x + fe(g) + fe(g)&fe(even)"):
        m = reg(wide, f, save="all")
        assert np.allclose(m.coef, one.coef) and m.rss == pytest.approx(one.rss, rel=1e-9)
        assert m.residuals().where("residual is not null").count() == m.nobs
    # a column that the effects explain is left out
    m = reg(wide, "y ~ x + g2 + fe(g)")
    assert m.coef[1] == 0 and np.isnan(m.stderror[1])


def test_a_key_as_a_regressor_is_told(df, monkeypatch):
    from panelspark.plans import design

    monkeypatch.setattr(design, "MOST", 4)
    with pytest.raises(ValueError, match="absorb it"):
        reg(df, "y ~ s")


def test_iterations(df, caplog):
    with caplog.at_level(logging.INFO, logger="panelspark"):
        m = reg(df, "y ~ x + fe(g) + fe(h)", maxiter=1)
    assert not m.converged and "before it met its tolerance" in caplog.text
    assert reg(df, "y ~ x + fe(g)").iterations == 1 and reg(df, "y ~ x + fe(g) + fe(h)").converged


def test_singleton_rules(spark):
    rows = [(1.0, 1.0, "a", "p"), (2.0, 3.0, "a", "p"), (4.0, 2.0, "b", "p"), (5.0, 2.5, "b", "q"), (3.0, 0.5, "a", "p"), (2.5, 1.5, "b", "p")]
    df = spark.createDataFrame(rows, "y double, x double, g string, h string")
    assert reg(df, "y ~ x + fe(g) + fe(h)").nobs == 5
    assert reg(df, "y ~ x + fe(g) + fe(h)", singletons="compat").nobs == 6
    assert reg(df, "y ~ x + fe(g) + fe(h)", drop_singletons=False).nobs == 6


def test_no_plan_has_a_cross_join(df):
    m = reg(df, "y ~ x + fe(g) + fe(h)", save="all")
    for out in (m.predict(df), m.residuals(), m.fe(), m.esample()):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Inner\n" not in plan and "Cartesian" not in plan


def test_unknown_conditions_are_false(spark):
    df = spark.createDataFrame([(1.0, 1.0, True), (2.0, 3.0, None), (4.0, 2.0, True), (5.0, 7.0, False), (6.0, 1.0, True), (None, 1.0, True)], "y double, x double, keep boolean")
    m = reg(df, "y ~ x", subset="keep", save="all")
    assert m.nobs == 3
    used = {(r.y, r.x): r._esample for r in m.esample().collect()}
    assert used == {(1.0, 1.0): True, (2.0, 3.0): False, (4.0, 2.0): True, (5.0, 7.0): False, (6.0, 1.0): True, (None, 1.0): False}
    assert m.residuals().where("residual is null").count() == 3
