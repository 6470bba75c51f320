"""Formulas, distributions, algebra, pruning and sources."""

import math

import numpy as np
import pytest

from panelspark import FormulaError, has_fe, has_iv, parse, parse_fixed_effects
from panelspark.functions import distributions as dist
from panelspark.functions import linear
from panelspark.operators.sample import prune
from panelspark.sources.tables import read, write


def shape(text):
    f = parse(text)
    show = lambda parts: ["&".join(map(str, p)) for p in parts]
    return [str(r) for r in f.responses], show(f.exogenous), show(f.endogenous), show(f.instruments), [e.name for e in f.effects], f.intercept


@pytest.mark.parametrize(
    "text, want",
    [
        ("y ~ x1 + x2", (["y"], ["x1", "x2"], [], [], [], True)),
        ("y ~ 0 + x", (["y"], ["x"], [], [], [], False)),
        ("y ~ x - 1", (["y"], ["x"], [], [], [], False)),
        ("y ~ 1", (["y"], [], [], [], [], True)),
        ("y ~ a*b + c", (["y"], ["a", "b", "c", "a&b"], [], [], [], True)),
        ("y ~ x + fe(a)&fe(b)", (["y"], ["x"], [], [], ["fe_a&fe_b"], True)),
        ("y ~ x&fe(a)", (["y"], [], [], [], ["fe_a&x"], True)),
        ("y ~ fe(a)*x", (["y"], ["x"], [], [], ["fe_a", "fe_a&x"], True)),
        ("y ~ fe(a) + fe(a)*x", (["y"], ["x"], [], [], ["fe_a", "fe_a&x"], True)),
        ("y ~ fe(a)*fe(b)", (["y"], [], [], [], ["fe_a", "fe_b", "fe_a&fe_b"], True)),
        ("y ~ fe(a)&x&z", (["y"], [], [], [], ["fe_a&x&z"], True)),
        ("y ~ (e ~ z) + x", (["y"], ["x"], ["e"], ["z"], [], True)),
        ("y ~ (e1 + e2 ~ z + e2) + x", (["y"], ["x", "e2"], ["e1"], ["z"], [], True)),
        ("a + b ~ x", (["a", "b"], ["x"], [], [], [], True)),
        ("log(y) ~ x^2 + log(1 + x/2) + `odd name`", (["log(y)"], ["x ^ 2", "log(1 + x / 2)", "odd name"], [], [], [], True)),
    ],
)
def test_formulas(text, want):
    assert shape(text) == want


@pytest.mark.parametrize("text", ["y", "y ~", "y ~ x +", "y ~ 2", "y ~ (x ~ x)", "y ~ (a + b ~ c)", "y ~ (a ~ b) + (c ~ d)", "y ~ x ? z", "y ~ (a ~ z)&b", "y ~ x) "])
def test_bad_formulas(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_predicates_and_effects():
    assert has_iv("y ~ (a ~ b)") and not has_iv("y ~ a") and has_fe("y ~ fe(g)") and not has_fe("y ~ g")
    effects, names, keys = parse_fixed_effects("y ~ x + fe(a)&fe(b) + fe(c)&x")
    assert names == ["fe_a&fe_b", "fe_c&x"] and keys == ["a", "b", "c"] and len(effects) == 2


def test_distributions():
    assert math.isclose(dist.t_quantile(45, 0.975), 2.014103388880846, rel_tol=1e-12)
    assert math.isclose(dist.t_quantile(1, 0.75), 1.0, rel_tol=1e-12) and dist.t_quantile(3, 0.5) == 0 and dist.t_quantile(5, 0.1) < 0
    assert math.isclose(dist.chi2_tail(2, 3.0), math.exp(-1.5), rel_tol=1e-12) and math.isclose(dist.chi2_tail(4, 9.0), math.exp(-4.5) * 5.5, rel_tol=1e-12)
    assert math.isclose(dist.f_tail(2, 8, 3.0), (1 + 2 * 3 / 8) ** -4, rel_tol=1e-12)
    assert math.isnan(dist.f_tail(0, 5, 1.0)) and dist.f_tail(3, 5, math.inf) == 0 and dist.f_tail(3, 5, -1) == 1 and math.isnan(dist.chi2_tail(1, math.nan))


def test_bases_keep_the_first():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(2, 50))
    m = np.column_stack([a, b, a, a + b])
    assert linear.basis(m.T @ m).tolist() == [True, True, False, False]
    near = np.column_stack([np.ones(6), 44.51 + 0.003 * rng.normal(size=6)])
    assert linear.basis(near.T @ near, intercept_first=True).all()
    q = linear.polar(rng.normal(size=(3, 3)))
    assert np.allclose(q @ q.T, np.eye(3))


def test_pruning_rules():
    # the second effect has a row alone, the first has none
    codes = [np.array([0, 0, 1, 1]), np.array([0, 0, 0, 1])]
    counts = np.ones(4, int)
    assert prune(codes, counts).tolist() == [True, True, False, False]
    assert prune(codes, counts, "compat").all()


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_sources(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, 2.5, "a"), (2, None, "b")], "a int, b double, c string")
    write(df, f"{tmp_path}/t.{kind}", kind)
    got = read(spark, f"{tmp_path}/t.{kind}")
    assert sorted((r.a, r.b, r.c) for r in got.collect()) == [(1, 2.5, "a"), (2, None, "b")]
