"""Small tables with known answers."""

import math

import numpy as np
import pytest

from panelspark import Cluster, Dummy, FormulaError, Robust, fn, formula, partial_out, reg, var
from panelspark import fe as fe_term


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def test_plain_and_missing(spark):
    df = frame(spark, "a double, b double", [(1.0, -0.3), (2.0, 0.1), (3.0, 0.7), (4.0, 0.7)])
    m = reg(df, "b ~ a")
    x, y = np.array([1, 2, 3, 4.0]), np.array([-0.3, 0.1, 0.7, 0.7])
    slope = np.polyfit(x, y, 1)[::-1]
    assert np.allclose(m.coef, slope) and m.coefnames == ["(Intercept)", "a"] and m.nobs == 4
    df = frame(spark, "a double, b double", [(1.0, -0.3), (None, 0.1), (3.0, 0.7), (4.0, 0.7)])
    assert np.allclose(reg(df, "b ~ a").coef, np.polyfit(x[[0, 2, 3]], y[[0, 2, 3]], 1)[::-1])


def test_integers_and_a_category(spark):
    df = frame(spark, "a int, b int, c int", [(1, 1, 1), (2, 2, 1), (3, 1, 2), (4, 3, 2)])
    x, y = np.array([1, 2, 3, 4.0]), np.array([1, 2, 1, 3.0])
    assert np.allclose(reg(df, "b ~ a").coef, np.polyfit(x, y, 1)[::-1])
    xd, yd = x - [1.5, 1.5, 3.5, 3.5], y - [1.5, 1.5, 2, 2]
    assert np.allclose(reg(df, "b ~ a + fe(c)").coef, (xd @ yd) / (xd @ xd))


# fixed values: id, instrument, regressor, response of two groups of ten
TWO_GROUPS = [
    (1, 0.3926958405512311, 0.6267661430572213, 1.4718803238847464),
    (1, 0.7600111011483996, 1.070267961053303, 2.481134786882455),
    (1, 0.9235331573676804, 1.2396399964004945, 2.861441726429744),
    (1, 0.49081257708561066, 0.8155371355271047, 1.7024281847845923),
    (1, 0.6179374617475177, 0.8854302878311572, 1.8597800985811714),
    (1, 0.5561290255886562, 0.8342386118008872, 1.7829458232379427),
    (1, 0.7106061100650756, 0.8317220504050142, 2.3831801938402926),
    (1, 0.9026730388431992, 1.3522506740907407, 2.8986778463875766),
    (1, 0.3221053229032633, 0.819778315030829, 1.0421739233166982),
    (1, 0.3139807630198339, 0.5627702520283105, 1.1119466723964109),
    (2, 0.9433788919067305, 1.3186562181088624, 3.048831670464759),
    (2, 0.6630986955705465, 0.7195187341429145, 2.163036501124449),
    (2, 0.29866302008663514, 0.7881057878284323, 0.9345125617373173),
    (2, 0.7664347069712338, 1.1582166227830843, 2.377552233133558),
    (2, 0.18249291268618184, 0.5938495477185608, 0.779872038394012),
    (2, 0.8774389972524512, 1.3475504976516746, 2.865161062580209),
    (2, 0.06668467014348822, 0.48231098887345913, 0.48953083375998435),
    (2, 0.25034519102852615, 0.5545386445160801, 0.8816106844386571),
    (2, 0.5291881219177967, 0.717749384307103, 1.8198545521724045),
    (2, 0.0002150924657149389, 0.4813039959324702, 0.2748138425702526),
]


def test_first_stage_statistic(spark):
    rows = [(i, y, x * (i == 1), x * (i == 2), z * (i == 1), z * (i == 2)) for i, z, x, y in TWO_GROUPS]
    df = spark.createDataFrame(rows, "id long, Y double, X1 double, X2 double, Z1 double, Z2 double")
    m = reg(df, "Y ~ fe(id) + (X1 + X2 ~ Z1 + Z2)", Robust())
    assert abs(m.F_kp - 14.5348449357) < 1e-6
    assert math.isnan(reg(df, "Y ~ fe(id) + (X1 + X2 ~ Z1 + Z2)", Robust(), first_stage=False).F_kp)


def test_scales_and_near_constants(spark):
    y = [100.0, -40.0, 30.0, 20.0]
    m = reg(frame(spark, "y double, x double", [(v, v**4) for v in y]), "y ~ x")
    assert np.all(m.coef != 0)
    rows = [(44.5098, 44.5117, 1.0), (44.5119, 44.5090, 2.0), (44.5111, 44.5132, 0.5), (44.5145, 44.5098, 1.5), (44.5102, 44.5121, 2.5), (44.5087, 44.5105, 1.2)]
    m = reg(frame(spark, "x1 double, x2 double, y double", rows), "y ~ x1 + x2")
    assert not np.isnan(m.stderror).any()


def test_constants_only(spark):
    df = frame(spark, "y double", [(1.0,), (2.0,), (3.0,)])
    m = reg(df, "y ~ 1", save="residuals")
    assert [r.prediction for r in m.predict(df).collect()] == [2.0] * 3
    assert [r.residual for r in m.residuals(df).orderBy("y").collect()] == [-1.0, 0.0, 1.0]
    assert [r.residual for r in m.residuals().orderBy("y").collect()] == [-1.0, 0.0, 1.0]
    assert [r.prediction for r in reg(df, "y ~ 0").predict(df).collect()] == [0.0] * 3
    assert math.isnan(m.F)


def test_errors(spark):
    rows = [(1.0, 1.0, 2.0, 1.0), (2.0, 3.0, 1.0, 1.0), (4.0, 2.0, 2.5, float("inf"))]
    df = frame(spark, "y double, x double, z double, w double", rows)
    with pytest.raises(ValueError, match="save"):
        reg(df, "y ~ x", save="nothing")
    with pytest.raises(ValueError, match="empty"):
        reg(df, "y ~ x", subset="y > 100")
    with pytest.raises(ValueError, match="weights hold an infinite"):
        reg(df, "y ~ x", weights="w")
    with pytest.raises(ValueError, match="variant"):
        reg(df, "y ~ x").adjr2("other")
    with pytest.raises(ValueError, match="variant"):
        reg(df, "y ~ x").r2("other")
    with pytest.raises(FormulaError):
        reg(df, "y ~ x + (z ~ z)")
    with pytest.raises(FormulaError):
        reg(df, "y ~ (x + z ~ w)")
    with pytest.raises(FormulaError):
        reg(df, "y ~ nothing_here")
    with pytest.raises(TypeError):
        reg([1, 2], "y ~ x")
    with pytest.raises(TypeError):
        reg(df, "y ~ x").predict(1)
    with pytest.raises(TypeError):
        reg(df, "y ~ x", subset=[True])
    for bad, said in (("y", "response"), ("x", "the regressors"), ("z", "instruments"), ("e", "endogenous")):
        base = [[1.0, 2.0, 3.0, 4.0], [2.0, 1.0, 5.0, 3.0], [4.0, 4.0, 1.0, 1.0]]
        base[1]["yxze".index(bad)] = float("inf") if bad != "x" else float("nan")
        with pytest.raises(ValueError, match=said):
            reg(frame(spark, "y double, x double, z double, e double", [tuple(r) for r in base]), "y ~ x + (e ~ z)")
    with pytest.raises(ValueError, match="response"):
        reg(frame(spark, "y double, x double", [(0.0, 1.0), (1.0, 2.0), (2.0, 4.0)]), "log(y) ~ x")
    with pytest.raises(TypeError, match="cannot use"):
        reg(frame(spark, "y double, x array<int>", [(1.0, [1])]), "y ~ x")


def test_effects_need_saving(spark):
    df = frame(spark, "y double, x double, g string", [(1.0, 1.0, "a"), (2.0, 3.0, "a"), (4.0, 2.0, "b"), (5.0, 2.5, "b")])
    m = reg(df, "y ~ x + fe(g)")
    for call in (lambda: m.predict(df), lambda: m.residuals(df), lambda: m.residuals(), lambda: m.fe(), lambda: reg(df, "y ~ x", save="all").fe()):
        with pytest.raises(ValueError):
            call()
    s = reg(df, "y ~ x + fe(g)&x", save="all")
    with pytest.raises(ValueError):
        s.predict(df)
    assert m.has_fe and not m.has_iv and m.islinear


def test_partial_out_small(spark):
    df = frame(spark, "y double, g string", [(1.0, "a"), (2.0, None), (3.0, "b"), (5.0, "b")])
    out = partial_out(df, "y ~ fe(g)")
    assert [r._esample for r in out.esample.orderBy("y").collect()] == [True, False, True, True]
    assert [r.resid_y for r in out.df.orderBy("y").collect()] == [0.0, None, -1.0, 1.0]
    assert partial_out(df, "y ~ fe(g)", align=False).df.count() == 3
    assert partial_out(df, "y ~ fe(g)", drop_singletons=True, align=False).df.count() == 2
    with pytest.raises(ValueError):
        partial_out(frame(spark, "y double, x double, z double", [(1.0, 2.0, 3.0)] * 3), "y ~ (x ~ z)")
    with pytest.raises(ValueError, match="empty"):
        partial_out(frame(spark, "y double, x double", [(None, 1.0)]), "y ~ x")


def test_ignored_options_and_names(spark, caplog):
    df = frame(spark, "y double, x double", [(1.0, 1.0), (2.0, 3.0), (4.0, 2.0)])
    m = reg(df, "y ~ x", nthreads=2, method="gpu")
    assert "deprecated" in caplog.text and "ignored" in caplog.text
    assert m.responsename == "y" and "(Intercept)" in repr(m) and m.coeftable(0.9).columns[-1] == "Upper 90%"
    assert m.coeftable().names[-1] == "(Intercept)"


def test_terms_in_python(spark):
    df = frame(spark, "y double, x double, g string", [(1.0, 1.0, "a"), (2.0, 3.0, "a"), (4.0, 2.0, "b"), (5.0, 2.5, "b"), (5.5, 1.0, "b")])
    a = reg(df, formula(var("y"), var("x") + fe_term("g")))
    assert np.allclose(a.coef, reg(df, "y ~ x + fe(g)").coef)
    doubled = reg(df, formula("y", fn(lambda c: 2 * c, "x", name="twice")))
    assert doubled.coefnames[1] == "twice(x)"
    assert np.allclose(2 * doubled.coef[1], reg(df, "y ~ x").coef[1])
    named = reg(df, "y ~ twice(x)", functions={"twice": lambda c: 2 * c})
    assert np.allclose(named.coef, doubled.coef)


def test_dummy_base_and_cluster_names(spark):
    df = frame(spark, "y double, t int", [(1.0, 80), (2.0, 81), (4.0, 82), (5.0, 80), (3.0, 81), (4.5, 82)])
    m = reg(df, "y ~ t", contrasts={"t": Dummy(base=81)})
    assert m.coefnames == ["(Intercept)", "t: 80", "t: 82"] and np.allclose(m.coef, [2.5, 0.5, 1.75])
    assert reg(df, "y ~ 1", Cluster("t")).nclusters == {"t": 3}
