"""Models against dense linear algebra with explicit indicator columns."""

import numpy as np
import pandas as pd
import pytest

from panelspark import Cluster, Robust, Simple, partial_out, reg
from panelspark.operators import absorb


def panel(seed=0, n=400):
    rng = np.random.default_rng(seed)
    g, h, t = rng.integers(0, 25, n), rng.integers(0, 12, n), rng.integers(0, 6, n)
    z, z2, x, u = rng.normal(size=(4, n))
    e = 0.7 * z + 0.4 * z2 + 0.5 * u + rng.normal(size=n) * 0.5
    v = 5 + rng.normal(size=n)
    y = 3 + x - 2 * e + g * 0.3 + h * 0.2 * v + u + rng.normal(size=n) * (1 + 0.5 * np.abs(x))
    return pd.DataFrame({"y": y, "x": x, "e": e, "z": z, "z2": z2, "v": v, "w": rng.uniform(0.5, 2, n), "g": g, "h": h, "t": t, "s": [f"s{k}" for k in t]})


@pytest.fixture(scope="module")
def data(spark):
    pdf = panel()
    return pdf, spark.createDataFrame(pdf).repartition(3).cache()


def dummies(codes, slope=None):
    d = (codes[:, None] == np.unique(codes)[None]).astype(float)
    return d * slope[:, None] if slope is not None else d


def pruned(pdf, keys):
    keep = np.ones(len(pdf), bool)
    while True:
        before = keep.sum()
        for k in keys:
            size = pdf[keep].groupby(k).size()
            single = pdf.set_index(k).index.map(size).to_numpy() == 1
            keep &= ~single
        if keep.sum() == before:
            return keep


def dense(pdf, exo, d, dof_fes, endo=(), inst=(), w=None, intercept=False, vcov="simple", clusters=()):
    n = len(pdf)
    w = np.ones(n) if w is None else w
    r = np.sqrt(w)[:, None]
    cols = lambda names: np.column_stack([pdf[c] if isinstance(c, str) else c for c in names]) if len(names) else np.zeros((n, 0))
    y, x, en, zi = pdf[["y"]].to_numpy(), cols(exo), cols(endo), cols(inst)
    if intercept:
        x = np.column_stack([np.ones(n), x])
    if d is not None:
        proj = lambda m: m - d @ np.linalg.lstsq(d * r, m * r, rcond=None)[0]
        y, x, en, zi = (proj(m) if m.shape[1] else m for m in (y, x, en, zi))
    y, x, en, zi = y * r, x * r, en * r, zi * r
    zz = np.column_stack([x, zi])
    hat = np.column_stack([x, zz @ np.linalg.lstsq(zz, en, rcond=None)[0]]) if len(endo) else x
    full = np.column_stack([x, en])
    a = np.linalg.inv(hat.T @ hat)
    b = a @ hat.T @ y
    res = (y - full @ b)[:, 0]
    k = full.shape[1]
    dof = n - k - dof_fes
    scores = hat * res[:, None]
    if vcov == "simple":
        v = a * (res @ res) / dof
    elif vcov == "robust":
        v = a @ (scores.T @ scores) @ a * n / dof
    else:
        meat = np.zeros((k, k))
        from itertools import combinations

        for size in range(1, len(clusters) + 1):
            for c in combinations(clusters, size):
                s = pd.DataFrame(scores).groupby([pdf[i].to_numpy() for i in c]).sum().to_numpy()
                meat += (-1) ** (size + 1) * s.T @ s
        g = min(pdf[c].nunique() for c in clusters)
        v = a @ meat @ a * (n - 1) / dof * g / (g - 1)
    return b[:, 0], np.sqrt(np.diag(v)), res @ res, y


def check(m, b, se, rss):
    assert np.allclose(m.coef, b, rtol=1e-7, atol=1e-9), (m.coef, b)
    assert np.allclose(m.stderror, se, rtol=1e-6), (m.stderror, se)
    assert np.isclose(m.rss, rss, rtol=1e-8)


def test_plain_models(data):
    pdf, df = data
    for vcov, kind, cl in ((Simple(), "simple", ()), (Robust(), "robust", ()), (Cluster("g"), "cluster", ["g"]), (Cluster("g", "h"), "cluster", ["g", "h"])):
        for w in (None, "w"):
            check(reg(df, "y ~ x + e", vcov, weights=w), *dense(pdf, ["x", "e"], None, 0, intercept=True, w=None if w is None else pdf.w.to_numpy(), vcov=kind, clusters=cl)[:3])
    check(reg(df, "y ~ 0 + x + e", Robust()), *dense(pdf, ["x", "e"], None, 0, vcov="robust")[:3])
    m = reg(df, "y ~ x")
    y = pdf.y.to_numpy()
    assert np.isclose(m.tss, ((y - y.mean()) ** 2).sum()) and np.isclose(m.r2(), 1 - m.rss / m.tss) and m.dof == 1 and m.dof_residual == len(pdf) - 3


@pytest.mark.parametrize("groups", [200_000, 0])
def test_one_effect(data, monkeypatch, groups):
    """Solved on the driver, and by column expressions over the table of groups."""
    pdf, df = data
    monkeypatch.setattr(absorb, "GROUPS", groups)
    keep = pruned(pdf, [["g"]])
    p = pdf[keep].reset_index(drop=True)
    d, k = dummies(p.g.to_numpy()), p.g.nunique()
    check(reg(df, "y ~ x + e + fe(g)"), *dense(p, ["x", "e"], d, k)[:3])
    check(reg(df, "y ~ x + e + fe(g)", Robust(), weights="w"), *dense(p, ["x", "e"], d, k, w=p.w.to_numpy(), vcov="robust")[:3])
    check(reg(df, "y ~ x + e + fe(g)", Cluster("g")), *dense(p, ["x", "e"], d, 1, vcov="cluster", clusters=["g"])[:3])
    w = p.w.to_numpy()
    check(reg(df, "y ~ x + (e ~ z + z2) + fe(g)", Cluster("g"), weights="w"), *dense(p, ["x"], d, 1, ["e"], ["z", "z2"], w=w, vcov="cluster", clusters=["g"])[:3])
    slow, fast = reg(df.selectExpr("*", "g as g2"), "y ~ x + (e ~ z + z2) + fe(g)", Cluster("g2")), reg(df, "y ~ x + (e ~ z + z2) + fe(g)", Cluster("g"))
    assert np.isclose(slow.F_kp, fast.F_kp) and np.allclose(slow.stderror, fast.stderror) and slow.nclusters["g2"] == fast.nclusters["g"]
    hs = dummies(pdf.h.to_numpy(), pdf.v.to_numpy())
    m = reg(df, "y ~ x + fe(h)*v", Cluster("h"))
    b, se, *_ = dense(pdf, ["x"], np.hstack([dummies(pdf.h.to_numpy()), hs]), 2, vcov="cluster", clusters=["h"])
    assert np.isclose(m.coef[0], b[0]) and np.isclose(m.stderror[0], se[0])
    check(reg(df, "y ~ x + e + fe(g)", Cluster("t")), *dense(p, ["x", "e"], d, k, vcov="cluster", clusters=["t"])[:3])


@pytest.mark.parametrize("groups", [200_000, 0])
def test_slopes(data, monkeypatch, groups):
    pdf, df = data
    monkeypatch.setattr(absorb, "GROUPS", groups)
    h, v = pdf.h.to_numpy(), pdf.v.to_numpy()
    levels, slopes = dummies(h), dummies(h, v)
    m = reg(df, "y ~ x + fe(h)*v", Robust())
    b, se, rss, _ = dense(pdf, ["x"], np.hstack([levels, slopes]), 24, vcov="robust")
    assert np.isclose(m.coef[0], b[0]) and np.isclose(m.stderror[0], se[0]) and np.isclose(m.rss, rss) and m.coef[1] == 0 and np.isnan(m.stderror[1])
    check(reg(df, "y ~ x + fe(h)&v"), *[np.array(q)[[0, 1]] if np.ndim(q) else q for q in dense(pdf, ["x"], slopes, 12, intercept=True)[:3]])
    check(reg(df, "y ~ 0 + x + v&fe(h)", Robust()), *dense(pdf, ["x"], slopes, 12, vcov="robust")[:3])


@pytest.mark.parametrize("cells", [3_000_000, 0])
def test_many_effects(data, monkeypatch, cells):
    """Solved on the driver, and by tables of groups."""
    pdf, df = data
    monkeypatch.setattr(absorb, "CELLS", cells)
    keep = pruned(pdf, [["g"], ["h"]])
    p = pdf[keep].reset_index(drop=True)
    d = np.hstack([dummies(p.g.to_numpy()), dummies(p.h.to_numpy())])
    k = p.g.nunique() + p.h.nunique()
    m = reg(df, "y ~ x + e + fe(g) + fe(h)", Robust(), weights="w", save="all")
    check(m, *dense(p, ["x", "e"], d, k, w=p.w.to_numpy(), vcov="robust")[:3])
    assert m.converged and m.dof_fes == k
    if cells:
        d = np.hstack([dummies(p.g.to_numpy()), dummies(p.h.to_numpy()), dummies(p.h.to_numpy(), p.v.to_numpy())])
        m = reg(df, "y ~ x + e + fe(g) + fe(h) + fe(h)&v", Cluster("g"))
        check(m, *dense(p, ["x", "e"], d, 1 + 2 * p.h.nunique(), vcov="cluster", clusters=["g"])[:3])


def test_interacted_keys_and_singletons(data):
    pdf, df = data
    keep = pruned(pdf, [["g", "h"]])
    p = pdf[keep].reset_index(drop=True)
    code = p.g.to_numpy() * 100 + p.h.to_numpy()
    m = reg(df, "y ~ x + fe(g)&fe(h)")
    check(m, *dense(p, ["x"], dummies(code), len(np.unique(code)))[:3])
    assert m.nobs == keep.sum() and m.n_singletons == (~keep).sum()
    keep = pruned(pdf, [["g", "h"], ["t"]])
    p = pdf[keep].reset_index(drop=True)
    code = p.g.to_numpy() * 100 + p.h.to_numpy()
    m = reg(df, "y ~ x + fe(g)&fe(h) + fe(t)", Robust())
    check(m, *dense(p, ["x"], np.hstack([dummies(code), dummies(p.t.to_numpy())]), len(np.unique(code)) + p.t.nunique(), vcov="robust")[:3])


def test_instruments(data):
    pdf, df = data
    for vcov, kind, cl in ((Simple(), "simple", ()), (Robust(), "robust", ()), (Cluster("g"), "cluster", ["g"])):
        check(reg(df, "y ~ x + (e ~ z + z2)", vcov), *dense(pdf, ["x"], None, 0, ["e"], ["z", "z2"], intercept=True, vcov=kind, clusters=cl)[:3])
    d = dummies(pdf.h.to_numpy())
    m = reg(df, "y ~ x + (e ~ z + z2) + fe(h)", Robust(), weights="w")
    check(m, *dense(pdf, ["x"], d, 12, ["e"], ["z", "z2"], w=pdf.w.to_numpy(), vcov="robust")[:3])
    assert m.F_kp > 10 and 0 <= m.p_kp < 0.01 and m.coefnames == ["x", "e"]
    # an endogenous variable that is its own instrument is exogenous
    same = reg(df.selectExpr("*", "e as e2"), "y ~ x + (e ~ e2 + z)")
    assert np.allclose(same.coef, reg(df, "y ~ x + e").coef) and same.coefnames == ["(Intercept)", "x", "e"]


def test_categories(data):
    pdf, df = data
    d = dummies(pdf.t.to_numpy())
    m = reg(df, "y ~ x + s")
    b, se, rss, _ = dense(pdf, ["x", *d[:, 1:].T], None, 0, intercept=True)
    check(m, b, se, rss)
    assert m.coefnames == ["(Intercept)", "x", *(f"s: s{k}" for k in range(1, 6))]
    assert len(reg(df, "y ~ 0 + s").coef) == 6 and len(reg(df, "y ~ s + fe(h)").coef) == 5
    assert len(reg(df, "y ~ s&x").coef) == 7 and len(reg(df, "y ~ x + s&x").coef) == 7 and len(reg(df, "y ~ s*x").coef) == 12
    # indicators and absorbed levels are the same model
    assert np.allclose(reg(df, "y ~ x + s").coef[1], reg(df, "y ~ x + fe(t)").coef[0])


def test_row_outputs(data):
    pdf, df = data
    m = reg(df, "y ~ x + fe(g) + fe(h)", save="all")
    keep = pruned(pdf, [["g"], ["h"]])
    p = pdf[keep].reset_index(drop=True)
    d = np.hstack([dummies(p.g.to_numpy()), dummies(p.h.to_numpy())])
    x = np.column_stack([p.x, d])
    fitted = x @ np.linalg.lstsq(x, p.y.to_numpy(), rcond=None)[0]
    got = m.predict(m.residuals()).toPandas().set_index("y")
    assert list(got.columns) == [*(c for c in pdf.columns if c != "y"), "residual", "prediction"]
    assert np.allclose(got.loc[p.y, "prediction"], fitted) and np.allclose(got.loc[p.y, "residual"], p.y - fitted)
    used = m.esample().toPandas().set_index("y").loc[pdf.y, "_esample"].to_numpy()
    assert (used == keep).all()
    fe = m.fe(keepkeys=True)
    assert fe.columns == ["g", "h", "fe_g", "fe_h"] and m.fe().columns == ["fe_g", "fe_h"]
    total = m.fe(table=True).toPandas().set_index("y").loc[p.y]
    assert np.allclose(total["fe_g"] + total["fe_h"] + m.coef[0] * p.x.to_numpy(), fitted)


def test_predict_unseen_and_null_keys(spark):
    rng = np.random.default_rng(0)
    g, h, x = rng.integers(0, 3, 100), rng.integers(0, 2, 100), rng.normal(size=100)
    pdf = pd.DataFrame({"y": 2 * x + g + 3 * h, "x": x, "g": [f"g{k}" for k in g], "h": [f"h{k}" for k in h]})
    df = spark.createDataFrame(pdf)
    m = reg(df, "y ~ x + fe(g)", save="fe")
    new = spark.createDataFrame([(1.0, "g0", "h0"), (1.0, "new", "h0"), (None, "g0", "h0"), (1.0, None, "h0")], "x double, g string, h string")
    assert [r.prediction is None for r in m.predict(new).collect()] == [False, True, True, True]
    m2 = reg(df, "y ~ x + fe(g) + fe(h)", save="fe")
    got = m2.predict(df).toPandas()
    assert np.allclose(got.y, got.prediction)
    part = reg(df.where("not (g = 'g0' and h = 'h0')"), "y ~ x + fe(g) + fe(h)", save="fe")
    pair = spark.createDataFrame([(1.0, "g0", "h0")], "x double, g string, h string")
    assert part.predict(pair).first().prediction is None
    assert np.isclose(part.predict(pair, per_effect=True).first().prediction, 2.0)
    inter = reg(df, "y ~ x + fe(g)&fe(h)", save="fe").predict(df).toPandas()
    assert np.allclose(inter.y, inter.prediction)


def test_partial_out(data):
    pdf, df = data
    keep = np.ones(len(pdf), bool)
    d = np.hstack([dummies(pdf.g.to_numpy()), dummies(pdf.h.to_numpy())])
    design = np.column_stack([pdf.x, d])
    ys = pdf[["y", "e"]].to_numpy()
    want = ys - design @ np.linalg.lstsq(design, ys, rcond=None)[0]
    out = partial_out(df, "y + e ~ x + fe(g) + fe(h)")
    got = out.df.toPandas().set_index("z").loc[pdf.z]
    assert np.allclose(got[["resid_y", "resid_e"]], want) and keep.all() and out.dof_fes == d.shape[1] and len(out.iterations) == 3
    w = pdf.w.to_numpy()
    for formula, design in (("y ~ x", np.column_stack([np.ones(len(pdf)), pdf.x])), ("y ~ fe(h)&v + x", np.column_stack([np.ones(len(pdf)), pdf.x, dummies(pdf.h.to_numpy(), pdf.v.to_numpy())])), ("y ~ 1", np.ones((len(pdf), 1)))):
        r = np.sqrt(w)[:, None]
        b = np.linalg.lstsq(design * r, ys[:, :1] * r, rcond=None)[0]
        want = (ys[:, :1] - design @ b)[:, 0] + np.average(pdf.y, weights=w)
        got = partial_out(df, formula, weights="w", add_mean=True).df.toPandas().set_index("z").loc[pdf.z]
        assert np.allclose(got["resid_y"], want), formula


def test_likelihoods(data):
    pdf, df = data
    m = reg(df, "y ~ x + fe(h)")
    n = m.nobs
    assert np.isclose(m.loglikelihood, -n / 2 * (np.log(2 * np.pi * m.rss / n) + 1))
    assert np.isclose(m.r2("McFadden"), 1 - m.loglikelihood / m.nullloglikelihood)
    assert np.isclose(m.adjr2(), 1 - m.rss * (n - 1) / (m.tss * (n - 13)))
    assert np.isclose(m.adjr2("McFadden"), 1 - (m.loglikelihood - 12) / m.nullloglikelihood)
    within = m.rss / (1 - m.r2_within)
    assert np.isclose(m.nullloglikelihood_within, -n / 2 * (np.log(2 * np.pi * within / n) + 1))
    h = pdf.h.to_numpy()
    yd = pdf.y - pdf.groupby(h).y.transform("mean")
    assert np.isclose(within, (yd**2).sum()) and np.isclose(m.mss, m.tss - m.rss)
    low, high = m.confint()[0]
    assert low < m.coef[0] < high


def test_subset_equals_filter(data):
    _, df = data
    a = reg(df, "y ~ x + fe(g)", subset="t < 3", weights="w")
    b = reg(df.where("t < 3"), "y ~ x + fe(g)", weights="w")
    c = reg(df.selectExpr("*", "case when t < 3 then x end as x3"), "y ~ x3 + fe(g)", weights="w")
    assert np.allclose(a.coef, b.coef) and np.allclose(a.coef, c.coef) and a.nobs == b.nobs == c.nobs


def test_wide_models(data):
    """More columns than are summed by generated code."""
    pdf, df = data
    names = [f"a{k}" for k in range(9)]
    rng = np.random.default_rng(3)
    for n in names:
        pdf = pdf.assign(**{n: rng.normal(size=len(pdf))})
    wide = df.sparkSession.createDataFrame(pdf)
    m = reg(wide, f"y ~ {' + '.join(names)} + x + x", Robust())
    check(m, *dense(pdf, [*names, "x"], None, 0, intercept=True, vcov="robust")[:3])
    check(reg(wide, f"y ~ {' + '.join(names)} + fe(h)", Cluster("g")), *dense(pdf, names, dummies(pdf.h.to_numpy()), 12, vcov="cluster", clusters=["g"])[:3])


def test_collinear_columns(data):
    _, df = data
    m = reg(df.selectExpr("*", "2 * x as x2"), "y ~ x + x2 + e")
    assert m.coef[2] == 0 and np.isnan(m.stderror[2]) and np.allclose(m.coef[[0, 1, 3]], reg(df, "y ~ x + e").coef)


@pytest.mark.parametrize("weights", [None, "w"])
def test_tables_iterate_like_the_driver(spark, monkeypatch, weights):
    """Level and slope of one key beside a second key: the same preconditioner, so about as many iterations."""
    from panelspark.operators import absorb

    rng = np.random.default_rng(12)
    n = 400
    rows = [(float(a), float(b), float(3 + c), int(i % 11), int(rng.integers(7)), float(d)) for i, (a, b, c, d) in enumerate(zip(rng.normal(size=n), rng.normal(size=n), rng.normal(size=n), rng.uniform(0.5, 2, n), strict=True))]
    df = spark.createDataFrame(rows, "y double, x double, z double, g int, h int, w double")
    there = reg(df, "y ~ x + fe(g)*z + fe(h)", weights=weights)
    monkeypatch.setattr(absorb, "CELLS", 0)
    here = reg(df, "y ~ x + fe(g)*z + fe(h)", weights=weights)
    assert abs(here.iterations - there.iterations) <= 2 and here.converged and here.iterations <= 50
    assert np.allclose(here.coef, there.coef, rtol=1e-7) and np.allclose(here.stderror, there.stderror, rtol=1e-6, equal_nan=True)


@pytest.mark.parametrize("formula, weights", [("y ~ x + fe(g)*z + fe(h)&fe(t)", "w"), ("y ~ x + fe(g)&fe(h) + fe(g)*z", None)])
def test_two_sets_take_half_the_steps(spark, monkeypatch, formula, weights):
    """Without broadcasts: one table of groups is written for two iterations of the driver's, to the same solution."""
    from panelspark.operators import absorb

    rng = np.random.default_rng(5)
    n = 600
    rows = [(float(a), float(b), float(3 + c), int(i // 6), int(rng.integers(30)), int(rng.integers(3)), float(d)) for i, (a, b, c, d) in enumerate(zip(rng.normal(size=n), rng.normal(size=n), rng.normal(size=n), rng.uniform(0.5, 2, n), strict=True))]
    df = spark.createDataFrame(rows, "y double, x double, z double, g int, h int, t int, w double")
    there = reg(df, formula, Robust(), weights=weights, save="all")
    written, write = [], absorb.checkpoint
    monkeypatch.setattr(absorb, "CELLS", 0)
    monkeypatch.setattr(absorb, "BROADCAST", 0)
    monkeypatch.setattr(absorb, "_prune_tables", lambda cells, keys, rule, f=absorb._prune_tables: (f(cells, keys, rule), written.clear())[0])
    monkeypatch.setattr(absorb, "checkpoint", lambda table: written.append(1) or write(table))
    here = reg(df, formula, Robust(), weights=weights, save="all")
    assert here.converged and abs(here.iterations - there.iterations) <= 2 and len(written) <= 8 + here.iterations / 2
    assert (here.nobs, here.n_singletons, here.dof_fes) == (there.nobs, there.n_singletons, there.dof_fes)
    assert np.allclose(here.coef, there.coef, rtol=1e-7) and np.allclose(here.stderror, there.stderror, rtol=1e-6, equal_nan=True)
    a, b = (sorted(tuple(r) for r in m.residuals().select("g", "h", "t", "y", "residual").collect() if r.residual is not None) for m in (here, there))
    assert len(a) == len(b) and np.allclose(np.array(a), np.array(b), atol=1e-7)


def test_two_sets_of_whole_keys_write_parts_not_rows(spark, monkeypatch):
    """Pruning and solution of cells that stay on the executors: no table with a row for each cell is written."""
    from panelspark.operators import absorb, blocks

    rng = np.random.default_rng(3)
    n = 300
    rows = [(float(a), float(b), int(i // 4), int(rng.integers(60)) if i > 9 else 100 + (i + 1) // 2) for i, (a, b) in enumerate(zip(rng.normal(size=n), rng.normal(size=n), strict=True))]
    df = spark.createDataFrame(rows, "y double, x double, g long, h int")
    there = reg(df, "y ~ x + fe(g) + fe(h)")
    written = []
    for module, name in ((absorb, "checkpoint"), (blocks, "settled")):
        monkeypatch.setattr(module, name, lambda table, f=getattr(module, name): (made := f(table), written.append(made.count()))[0])
    monkeypatch.setattr(absorb, "CELLS", 0)
    here = reg(df, "y ~ x + fe(g) + fe(h)")
    assert there.n_singletons > 0 and (here.nobs, here.n_singletons, here.dof_fes) == (there.nobs, there.n_singletons, there.dof_fes)
    assert np.allclose(here.coef, there.coef, rtol=1e-7) and here.converged
    assert written and max(written) < n / 2
