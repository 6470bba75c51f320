"""Registered queries of the estimator and the SQL they are compared with.

Coefficients, sums and statistics are rounded to six significant digits in both, as sums of doubles depend on
the order of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import Cluster, Dummy, Robust, partial_out, reg
from ..sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 6


def query(sql: str, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__], ORACLES[name or f.__name__] = f, sql
        return f

    return register


def signif(x: float) -> float | None:
    """Six significant digits; None for what is no number."""
    if x is None or math.isnan(x) or math.isinf(x):
        return None
    return 0.0 if x == 0 else round(float(x), DIGITS - 1 - math.floor(math.log10(abs(x)))) + 0.0


def sig_sql(x: str) -> str:
    # powers of ten with positive exponents only, which are exact
    place = f"CAST({DIGITS - 1} - floor(log10(abs({x}))) AS INTEGER)"
    return f"CASE WHEN ({x}) = 0 THEN 0.0 WHEN {place} >= 0 THEN round(({x}) * pow(10.0, {place})) / pow(10.0, {place}) ELSE round(({x}) / pow(10.0, -{place})) * pow(10.0, -{place}) END"


def terms(spark: SparkSession, m) -> DataFrame:
    return spark.createDataFrame([(n, signif(b), signif(s)) for n, b, s in zip(m.coefnames, m.coef, m.stderror, strict=True)], "term string, estimate double, std_error double")


def facts(spark: SparkSession, rows: dict) -> DataFrame:
    return spark.createDataFrame([(k, signif(v)) for k, v in rows.items()], "fact string, value double")


def term_rows(rows: list[tuple[str, str, str]], body: str) -> str:
    """SQL of (term, estimate, std_error) rows over common table expressions."""
    return f"WITH {body} " + " UNION ALL ".join(f"SELECT '{n}' AS term, {sig_sql(b)} AS estimate, {'CAST(NULL AS DOUBLE)' if s is None else sig_sql(s)} AS std_error FROM fit" for n, b, s in rows)


def lineitem(spark, sf_dir):
    return read(spark, f"{sf_dir}/lineitem.parquet")


def orders(spark, sf_dir):
    return read(spark, f"{sf_dir}/orders.parquet")


# ---- least squares --------------------------------------------------------------------------------------------

ONE = "fit AS (SELECT n, sxy / sxx AS b, my - sxy / sxx * mx AS a, (syy - sxy * sxy / sxx) / (n - 2) AS s2, sxx, mx, syy, sxy FROM (SELECT count(*) AS n, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy, regr_sxy({y}, {x}) AS sxy, avg({x}) AS mx, avg({y}) AS my FROM {t}))"


@query(term_rows([("(Intercept)", "a", "sqrt(s2 * (1.0 / n + mx * mx / sxx))"), ("l_quantity", "b", "sqrt(s2 / sxx)")], ONE.format(y="l_extendedprice", x="l_quantity", t="lineitem")))
def ols_one_regressor(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity"))


TWO = """m AS (SELECT count(*) AS n, avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM t),
c AS (SELECT any_value(n) AS n, any_value(my) AS my, any_value(m1) AS m1, any_value(m2) AS m2, sum((x1-m1)*(x1-m1)) AS s11, sum((x1-m1)*(x2-m2)) AS s12, sum((x2-m2)*(x2-m2)) AS s22, sum((x1-m1)*(y-my)) AS s1y, sum((x2-m2)*(y-my)) AS s2y, sum((y-my)*(y-my)) AS syy FROM t, m),
b AS (SELECT *, s11*s22-s12*s12 AS d, (s22*s1y-s12*s2y)/(s11*s22-s12*s12) AS b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) AS b2 FROM c)"""
LINE2 = "t AS (SELECT l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_suppkey AS g, l_partkey AS h FROM lineitem)"
NAMES2 = ["(Intercept)", "l_quantity", "l_discount"]


@query(
    term_rows(
        [("(Intercept)", "b0", "sqrt(s2 * (1.0/n + (m1*m1*s22 - 2*m1*m2*s12 + m2*m2*s11)/d))"), ("l_quantity", "b1", "sqrt(s2*s22/d)"), ("l_discount", "b2", "sqrt(s2*s11/d)")],
        f"{LINE2}, {TWO}, fit AS (SELECT *, my - b1*m1 - b2*m2 AS b0, (syy - b1*s1y - b2*s2y)/(n-3) AS s2 FROM b)",
    )
)
def ols_two_regressors(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + l_discount"))


#: The sandwich of the slopes: A = inverse of the centred cross-products, M = meat of the slopes' scores.
SANDWICH = "sqrt(k * (a{i}1*a{i}1*m11 + 2*a{i}1*a{i}2*m12 + a{i}2*a{i}2*m22))"
INV2 = "a AS (SELECT *, s22/d AS a11, -s12/d AS a12, -s12/d AS a21, s11/d AS a22 FROM b), e AS (SELECT t.*, a.m1, a.m2, t.y - a.my - a.b1*(t.x1-a.m1) - a.b2*(t.x2-a.m2) AS e FROM t, a), s AS (SELECT g, h, (x1-m1)*e AS s1, (x2-m2)*e AS s2 FROM e)"


@query(
    term_rows(
        [("l_quantity", "b1", SANDWICH.format(i=1)), ("l_discount", "b2", SANDWICH.format(i=2))],
        f"{LINE2}, {TWO}, {INV2}, z AS (SELECT sum(s1*s1) AS m11, sum(s1*s2) AS m12, sum(s2*s2) AS m22 FROM s), fit AS (SELECT *, n*1.0/(n-3) AS k FROM a, z)",
    )
)
def ols_robust(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + l_discount", Robust())).where("term <> '(Intercept)'")


@query(
    term_rows(
        [("l_quantity", "b1", SANDWICH.format(i=1)), ("l_discount", "b2", SANDWICH.format(i=2))],
        f"{LINE2}, {TWO}, {INV2}, c1 AS (SELECT sum(s1) AS u, sum(s2) AS v FROM s GROUP BY g), z AS (SELECT sum(u*u) AS m11, sum(u*v) AS m12, sum(v*v) AS m22, count(*)*1.0 AS gg FROM c1), fit AS (SELECT *, (n-1.0)/(n-3)*gg/(gg-1) AS k FROM a, z)",
    )
)
def ols_cluster(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + l_discount", Cluster("l_suppkey"))).where("term <> '(Intercept)'")


def _two_way(group: str) -> str:
    return f"(SELECT sum(u*u) AS m11, sum(u*v) AS m12, sum(v*v) AS m22, count(*)*1.0 AS gg FROM (SELECT sum(s1) AS u, sum(s2) AS v FROM s GROUP BY {group}))"


@query(
    term_rows(
        [("l_quantity", "b1", SANDWICH.format(i=1)), ("l_discount", "b2", SANDWICH.format(i=2))],
        f"{LINE2}, {TWO}, {INV2}, z AS (SELECT p.m11+q.m11-r.m11 AS m11, p.m12+q.m12-r.m12 AS m12, p.m22+q.m22-r.m22 AS m22, least(p.gg, q.gg) AS gg FROM {_two_way('g')} p, {_two_way('h')} q, {_two_way('g, h')} r), fit AS (SELECT *, (n-1.0)/(n-3)*gg/(gg-1) AS k FROM a, z)",
    )
)
def cluster_two_way(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + l_discount", Cluster("l_suppkey", "l_partkey"))).where("term <> '(Intercept)'")


@query(f"WITH t AS (SELECT sum(l_extendedprice*l_quantity) AS xy, sum(l_quantity*l_quantity) AS xx, sum(l_extendedprice*l_extendedprice) AS yy, count(*) AS n FROM lineitem) SELECT 'l_quantity' AS term, {sig_sql('xy/xx')} AS estimate, {sig_sql('sqrt((yy-xy*xy/xx)/(n-1)/xx)')} AS std_error FROM t")
def ols_no_intercept(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ 0 + l_quantity"))


WLS = "t AS (SELECT l_extendedprice AS y, l_discount AS x, l_quantity AS w FROM lineitem WHERE l_quantity > 0), m AS (SELECT sum(w) AS sw, sum(w*x)/sum(w) AS mx, sum(w*y)/sum(w) AS my, count(*) AS n FROM t), c AS (SELECT any_value(sw) AS sw, any_value(mx) AS mx, any_value(my) AS my, any_value(n) AS n, sum(w*(x-mx)*(x-mx)) AS sxx, sum(w*(x-mx)*(y-my)) AS sxy, sum(w*(y-my)*(y-my)) AS syy FROM t, m), fit AS (SELECT *, sxy/sxx AS b, (syy-sxy*sxy/sxx)/(n-2) AS s2 FROM c)"


@query(term_rows([("(Intercept)", "my - b*mx", "sqrt(s2*(1/sw + mx*mx/sxx))"), ("l_discount", "b", "sqrt(s2/sxx)")], WLS))
def wls(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_discount", weights="l_quantity"))


# ---- absorbed effects -----------------------------------------------------------------------------------------


def _within(keys: str, table: str = "lineitem", y: str = "l_extendedprice", x: str = "l_quantity", where: str = "true") -> str:
    """(y, x) about their group means, groups of one left out, and sums."""
    return f"r AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS size FROM {table} WHERE {where}), d AS (SELECT {keys}, {y} - avg({y}) OVER (PARTITION BY {keys}) AS y, {x} - avg({x}) OVER (PARTITION BY {keys}) AS x FROM r WHERE size > 1), gr AS (SELECT count(*) AS g FROM (SELECT DISTINCT {keys} FROM d)), c AS (SELECT count(*) AS n, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy FROM d)"


@query(term_rows([("l_quantity", "sxy/sxx", "sqrt((syy-sxy*sxy/sxx)/(n-1-g)/sxx)")], _within("l_suppkey") + ", fit AS (SELECT * FROM c, gr)"))
def fe_one_way(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + fe(l_suppkey)"))


NESTED = _within("l_suppkey") + ", s AS (SELECT d.l_suppkey, sum(d.x*(d.y - c.sxy/c.sxx*d.x)) AS s FROM d, c GROUP BY d.l_suppkey), z AS (SELECT sum(s*s) AS m, count(*)*1.0 AS gg FROM s), fit AS (SELECT * FROM c, z)"


@query(term_rows([("l_quantity", "sxy/sxx", "sqrt((n-1.0)/(n-1-1)*gg/(gg-1)*m)/sxx")], NESTED))
def fe_one_way_nested_cluster(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + fe(l_suppkey)", Cluster("l_suppkey")))


@query(term_rows([("l_quantity", "sxy/sxx", "sqrt((syy-sxy*sxy/sxx)/(n-1-g)/sxx)")], _within("l_orderkey") + ", fit AS (SELECT * FROM c, gr)"))
def fe_many_groups_with_singletons(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + fe(l_orderkey)"))


SLOPE = "p AS (SELECT l_suppkey AS g, sum(l_tax*l_extendedprice)/sum(l_tax*l_tax) AS sy, sum(l_tax*l_quantity)/sum(l_tax*l_tax) AS sx FROM lineitem GROUP BY 1), d AS (SELECT l_extendedprice - l_tax*sy AS y, l_quantity - l_tax*sx AS x FROM lineitem JOIN p ON l_suppkey = g), fit AS (SELECT count(*) AS n, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy, (SELECT count(*) FROM p) AS g FROM d)"


@query(term_rows([("l_quantity", "sxy/sxx", "sqrt((syy-sxy*sxy/sxx)/(n-1-g)/sxx)")], SLOPE))
def fe_slope(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ 0 + l_quantity + fe(l_suppkey)&l_tax", drop_singletons=False))


#: Group means are taken out in turn until they stay zero: 40 rounds are far more than these tables need.
TURNS = """WITH RECURSIVE s0 AS (SELECT l_orderkey, l_linenumber, l_suppkey AS g, l_partkey AS h, l_extendedprice AS y, l_quantity AS x, count(*) OVER (PARTITION BY l_partkey) AS ch, count(*) OVER (PARTITION BY l_suppkey) AS cg FROM lineitem),
it AS (SELECT 0 AS k, g, h, y, x FROM s0 WHERE ch > 1 AND cg > 1
UNION ALL
SELECT k + 1, g, h, y - avg(y) OVER (PARTITION BY h), x - avg(x) OVER (PARTITION BY h) FROM (SELECT k, g, h, y - avg(y) OVER (PARTITION BY g) AS y, x - avg(x) OVER (PARTITION BY g) AS x FROM it WHERE k < 40)),
d AS (SELECT * FROM it WHERE k = 40),
fit AS (SELECT count(*) AS n, sum(x*x) AS sxx, sum(x*y) AS sxy, sum(y*y) AS syy, count(DISTINCT g) + count(DISTINCT h) AS g FROM d) """


@query(TURNS + f"SELECT 'l_quantity' AS term, {sig_sql('sxy/sxx')} AS estimate, {sig_sql('sqrt((syy-sxy*sxy/sxx)/(n-1-g)/sxx)')} AS std_error FROM fit")
def fe_two_way(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + fe(l_suppkey) + fe(l_partkey)"))


@query(term_rows([("is_even", "sxy/sxx", "sqrt((syy-sxy*sxy/sxx)/(n-1-g)/sxx)")], "o AS (SELECT *, CAST(o_custkey % 2 AS DOUBLE) AS is_even FROM orders), " + _within("o_orderstatus, o_orderpriority", "o", "o_totalprice", "is_even") + ", fit AS (SELECT * FROM c, gr)"))
def fe_interacted_key(spark, sf_dir):
    df = orders(spark, sf_dir).selectExpr("*", "cast(o_custkey % 2 as double) as is_even")
    return terms(spark, reg(df, "o_totalprice ~ is_even + fe(o_orderstatus)&fe(o_orderpriority)"))


@query(f"WITH {_within('user_id', 'events', 'value', 'kind', 'true').replace('r AS (SELECT *,', 'ev AS (SELECT *, CAST(event_type = (SELECT min(event_type) FROM events) AS DOUBLE) AS kind FROM events), r AS (SELECT *,').replace('FROM events WHERE', 'FROM ev WHERE')} SELECT 'kind' AS term, {sig_sql('sxy/sxx')} AS estimate, {sig_sql('sqrt((syy-sxy*sxy/sxx)/(n-1-g)/sxx)')} AS std_error FROM c, gr")
def fe_event_panel(spark, sf_dir):
    df = read(spark, f"{sf_dir}/events.parquet")
    first = df.agg(F.min("event_type")).first()[0]
    return terms(spark, reg(df.withColumn("kind", (F.col("event_type") == first).cast("double")), "value ~ kind + fe(user_id)"))


# ---- instruments ----------------------------------------------------------------------------------------------

IV = "t AS (SELECT l_extendedprice AS y, l_quantity AS x, l_quantity + 10*l_tax + l_linenumber AS z FROM lineitem), m AS (SELECT count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(z) AS mz FROM t), c AS (SELECT any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum((z-mz)*(y-my)) AS szy, sum((z-mz)*(x-mx)) AS szx, sum((z-mz)*(z-mz)) AS szz, sum((x-mx)*(x-mx)) AS sxx, sum((x-mx)*(y-my)) AS sxy, sum((y-my)*(y-my)) AS syy FROM t, m), fit AS (SELECT *, szy/szx AS b, (syy - 2*szy/szx*sxy + szy/szx*szy/szx*sxx)/(n-2) AS s2, szx*szx/szz AS hh FROM c)"


@query(term_rows([("(Intercept)", "my - b*mx", "sqrt(s2*(1.0/n + mx*mx/hh))"), ("l_quantity", "b", "sqrt(s2/hh)")], IV))
def iv_just_identified(spark, sf_dir):
    df = lineitem(spark, sf_dir).selectExpr("*", "l_quantity + 10 * l_tax + l_linenumber as z")
    return terms(spark, reg(df, "l_extendedprice ~ (l_quantity ~ z)"))


IVFE = "t AS (SELECT l_suppkey AS g, l_extendedprice AS y, l_quantity AS x, l_quantity + 10*l_tax + l_linenumber AS z FROM lineitem), d AS (SELECT g, y - avg(y) OVER w AS y, x - avg(x) OVER w AS x, z - avg(z) OVER w AS z FROM t WINDOW w AS (PARTITION BY g)), c AS (SELECT count(*) AS n, sum(z*y) AS szy, sum(z*x) AS szx, sum(z*z) AS szz FROM d), s AS (SELECT g, sum(szx/szz*z*(y - szy/szx*x)) AS s FROM d, c GROUP BY g), fit AS (SELECT *, szx*szx/szz AS hh, szy/szx AS b FROM c, (SELECT sum(s*s) AS m, count(*)*1.0 AS gg FROM s))"


@query(term_rows([("l_quantity", "b", "sqrt((n-1.0)/(n-1-1)*gg/(gg-1)*m)/hh")], IVFE))
def iv_fe_cluster(spark, sf_dir):
    df = lineitem(spark, sf_dir).selectExpr("*", "l_quantity + 10 * l_tax + l_linenumber as z")
    return terms(spark, reg(df, "l_extendedprice ~ fe(l_suppkey) + (l_quantity ~ z)", Cluster("l_suppkey")))


#: With one instrument the rank statistic is the squared robust t-statistic of the first stage.
KP = "t AS (SELECT l_quantity AS x, l_quantity + 10*l_tax + l_linenumber AS z FROM lineitem), m AS (SELECT count(*) AS n, avg(x) AS mx, avg(z) AS mz FROM t), c AS (SELECT any_value(n) AS n, sum((z-mz)*(x-mx))/sum((z-mz)*(z-mz)) AS p, sum((z-mz)*(z-mz)) AS szz FROM t, m), v AS (SELECT sum(pow((z-mz)*(x-mx-p*(z-mz)), 2)) AS s FROM t, m, c), fit AS (SELECT p*p*szz*szz/(s*n/(n-2)) AS f FROM c, v)"


@query(f"WITH {KP} SELECT 'F_kp' AS fact, {sig_sql('f')} AS value FROM fit")
def iv_first_stage(spark, sf_dir):
    df = lineitem(spark, sf_dir).selectExpr("*", "l_quantity + 10 * l_tax + l_linenumber as z")
    return facts(spark, {"F_kp": reg(df, "l_extendedprice ~ (l_quantity ~ z)", Robust()).F_kp})


# ---- samples, categories, statistics --------------------------------------------------------------------------


@query(
    "WITH g AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) SELECT 'nobs' AS fact, CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS DOUBLE) AS value FROM g UNION ALL SELECT 'n_singletons', CAST(count(*) FILTER (c = 1) AS DOUBLE) FROM g UNION ALL SELECT 'dof_fes', CAST(count(*) FILTER (c > 1) AS DOUBLE) FROM g"
)
def singletons(spark, sf_dir):
    m = reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + fe(l_orderkey)")
    return spark.createDataFrame([("nobs", float(m.nobs)), ("n_singletons", float(m.n_singletons)), ("dof_fes", float(m.dof_fes))], "fact string, value double")


@query("SELECT 'l_suppkey' AS cluster_name, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS groups FROM lineitem UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey) FROM lineitem")
def cluster_counts(spark, sf_dir):
    m = reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity", Cluster("l_suppkey", "l_partkey"))
    return spark.createDataFrame(list(m.nclusters.items()), "cluster_name string, groups long")


def _means(rows: str) -> str:
    return f"WITH m AS (SELECT o_orderpriority AS p, avg(o_totalprice) AS a FROM orders GROUP BY 1), f AS (SELECT {rows} AS base) "


@query(
    _means("(SELECT min(p) FROM m)")
    + f"SELECT '(Intercept)' AS term, {sig_sql('a')} AS estimate FROM m, f WHERE p = base UNION ALL SELECT 'o_orderpriority: ' || p, {sig_sql('a - (SELECT a FROM m, f WHERE p = base)')} FROM m, f WHERE p <> base"
)
def categorical_dummies(spark, sf_dir):
    return terms(spark, reg(orders(spark, sf_dir), "o_totalprice ~ o_orderpriority")).select("term", "estimate")


@query(
    "WITH m AS (SELECT l_linenumber AS p, avg(l_extendedprice) AS a FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) "
    + f"SELECT '(Intercept)' AS term, {sig_sql('a')} AS estimate FROM m WHERE p = 2 UNION ALL SELECT 'l_linenumber: ' || p, {sig_sql('a - (SELECT a FROM m WHERE p = 2)')} FROM m WHERE p <> 2"
)
def contrasts_base(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_linenumber", contrasts={"l_linenumber": Dummy(base=2)}, subset="l_linenumber <= 3")).select("term", "estimate")


@query(f"SELECT 'l_returnflag: ' || l_returnflag || ' & l_quantity' AS term, {sig_sql('sum(l_quantity*l_extendedprice)/sum(l_quantity*l_quantity)')} AS estimate FROM lineitem GROUP BY l_returnflag")
def interaction_slopes(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ 0 + l_returnflag&l_quantity")).select("term", "estimate")


@query(
    term_rows(
        [("log(l_extendedprice)", "b", "sqrt(s2/sxx)"), ("(Intercept)", "a", "sqrt(s2 * (1.0 / n + mx * mx / sxx))")],
        "tt AS (SELECT sqrt(l_quantity) AS y, ln(l_extendedprice) AS x FROM lineitem), " + ONE.format(y="y", x="x", t="tt"),
    )
)
def function_terms(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "sqrt(l_quantity) ~ log(l_extendedprice)"))


FAMILY = ONE.format(y="l_extendedprice", x="l_quantity", t="lineitem").replace("fit AS", "f0 AS") + ", fit AS (SELECT *, syy - sxy*sxy/sxx AS rss, -n/2.0*(ln(2*pi()*(syy - sxy*sxy/sxx)/n)+1) AS ll, -n/2.0*(ln(2*pi()*syy/n)+1) AS l0 FROM f0)"
FACTS = {"rss": "rss", "tss": "syy", "mss": "syy - rss", "r2": "1 - rss/syy", "adjr2": "1 - rss*(n-1)/(syy*(n-2))", "loglikelihood": "ll", "nullloglikelihood": "l0", "r2_mcfadden": "1 - ll/l0", "adjr2_mcfadden": "1 - (ll-1)/l0", "F": "pow(sxy/sxx, 2)/(rss/(n-2)/sxx)", "nobs": "n", "dof": "1", "dof_residual": "n - 3"}


@query(f"WITH {FAMILY} " + " UNION ALL ".join(f"SELECT '{k}' AS fact, {sig_sql(f'CAST({v} AS DOUBLE)')} AS value FROM fit" for k, v in FACTS.items()))
def r2_family(spark, sf_dir):
    m = reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity")
    values = [m.rss, m.tss, m.mss, m.r2(), m.adjr2(), m.loglikelihood, m.nullloglikelihood, m.r2("McFadden"), m.adjr2("McFadden"), m.F, m.nobs, m.dof, m.dof_residual]
    return facts(spark, dict(zip(FACTS, values, strict=True)))


@query(f"WITH {_within('l_suppkey')} SELECT 'r2_within' AS fact, {sig_sql('sxy*sxy/sxx/syy')} AS value FROM c UNION ALL SELECT 'rss', {sig_sql('syy - sxy*sxy/sxx')} FROM c UNION ALL SELECT 'nullloglikelihood_within', {sig_sql('-n/2.0*(ln(2*pi()*syy/n)+1)')} FROM c")
def within_statistics(spark, sf_dir):
    m = reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + fe(l_suppkey)")
    return facts(spark, {"r2_within": m.r2_within, "rss": m.rss, "nullloglikelihood_within": m.nullloglikelihood_within})


@query(term_rows([("(Intercept)", "a", "sqrt(s2 * (1.0 / n + mx * mx / sxx))"), ("l_quantity", "b", "sqrt(s2 / sxx)"), ("twice", "0.0*n", None)], ONE.format(y="l_extendedprice", x="l_quantity", t="lineitem")))
def collinear_dropped(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir).selectExpr("*", "2 * l_quantity as twice"), "l_extendedprice ~ l_quantity + twice"))


HOLES = "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS q, CASE WHEN l_orderkey % 5 = 0 THEN NULL WHEN l_orderkey % 5 = 1 THEN -1.0 ELSE 1.0 END AS w"


@query(term_rows([("(Intercept)", "a", "sqrt(s2 * (1.0 / n + mx * mx / sxx))"), ("q", "b", "sqrt(s2 / sxx)")], f"tt AS (SELECT * FROM (SELECT l_extendedprice, {HOLES}, l_tax FROM lineitem) WHERE q IS NOT NULL AND w > 0 AND l_tax > 0.02), " + ONE.format(y="l_extendedprice", x="q", t="tt")))
def complete_cases(spark, sf_dir):
    df = lineitem(spark, sf_dir).selectExpr("l_extendedprice", *HOLES.split(", CASE")[:1], "CASE" + HOLES.split(", CASE")[1], "l_tax")
    return terms(spark, reg(df, "l_extendedprice ~ q", weights="w", subset="l_tax > 0.02"))


@query(term_rows([("(Intercept)", "a", "a/sqrt(s2 * (1.0 / n + mx * mx / sxx))"), ("l_quantity", "b", "b/sqrt(s2 / sxx)")], ONE.format(y="l_extendedprice", x="l_quantity", t="lineitem")).replace("std_error", "t_stat"))
def coefficient_table(spark, sf_dir):
    m = reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity")
    got = {r.term: r for r in m.coeftable_df(spark).collect()}
    return spark.createDataFrame([(n, signif(r.estimate), signif(r.t_stat)) for n, r in got.items()], "term string, estimate double, t_stat double")


# ---- rows -----------------------------------------------------------------------------------------------------

ROUND = 4


@query(f"SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority), {ROUND}) + 0.0 AS residual FROM orders")
def residuals_fe(spark, sf_dir):
    m = reg(orders(spark, sf_dir), "o_totalprice ~ fe(o_orderpriority)", save="residuals")
    return m.residuals().select("o_orderkey", (F.round("residual", ROUND) + 0.0).alias("residual"))


@query(f"WITH t AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders) SELECT o_orderkey, round(a + b * o_custkey, {ROUND}) + 0.0 AS prediction FROM orders, t")
def predict_plain(spark, sf_dir):
    df = orders(spark, sf_dir)
    return reg(df, "o_totalprice ~ o_custkey").predict(df).select("o_orderkey", (F.round("prediction", ROUND) + 0.0).alias("prediction"))


@query(f"SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority, o_orderstatus), {ROUND}) + 0.0 AS prediction FROM orders")
def predict_fe(spark, sf_dir):
    df = orders(spark, sf_dir)
    return reg(df, "o_totalprice ~ fe(o_orderpriority)&fe(o_orderstatus)", save="fe", drop_singletons=False).predict(df).select("o_orderkey", (F.round("prediction", ROUND) + 0.0).alias("prediction"))


@query(f"SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), {ROUND}) + 0.0 AS fe_o_orderpriority FROM orders")
def fe_recovered(spark, sf_dir):
    m = reg(orders(spark, sf_dir), "o_totalprice ~ fe(o_orderpriority)", save="fe")
    return m.fe(table=True).select("o_orderkey", (F.round("fe_o_orderpriority", ROUND) + 0.0).alias("fe_o_orderpriority"))


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) > 1 AS used FROM lineitem")
def esample(spark, sf_dir):
    return reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + fe(l_orderkey)").esample("used").select("l_orderkey", "l_linenumber", "used")


PARTIAL = "d AS (SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority) AS y, o_custkey - avg(o_custkey) OVER (PARTITION BY o_orderpriority) AS x, avg(o_totalprice) OVER () AS my FROM orders), b AS (SELECT sum(x*y)/sum(x*x) AS b FROM d)"


@query(f"WITH {PARTIAL} SELECT o_orderkey, round(y - b*x + my, {ROUND}) + 0.0 AS resid_o_totalprice FROM d, b", name="partial_out")
def partial_out_query(spark, sf_dir):
    out = partial_out(orders(spark, sf_dir), "o_totalprice ~ o_custkey + fe(o_orderpriority)", add_mean=True)
    return out.df.select("o_orderkey", (F.round("resid_o_totalprice", ROUND) + 0.0).alias("resid_o_totalprice"))


BOTH = "t AS (SELECT l_suppkey AS g, l_extendedprice - avg(l_extendedprice) OVER w AS y, l_quantity - avg(l_quantity) OVER w AS x, l_tax - avg(l_tax) OVER w AS t FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)), p AS (SELECT g, sum(t*y)/sum(t*t) AS sy, sum(t*x)/sum(t*t) AS sx FROM t GROUP BY g), r AS (SELECT y - sy*t AS y, x - sx*t AS x FROM t JOIN p USING (g)), c AS (SELECT count(*) AS n, sum(x*x) AS sxx, sum(x*y) AS sxy FROM r), fit AS (SELECT any_value(n) AS n, any_value(sxx) AS sxx, any_value(sxy) AS sxy, sum(pow(x*(y - sxy/sxx*x), 2)) AS m, (SELECT count(*) FROM p) AS g FROM r, c)"


@query(term_rows([("l_quantity", "sxy/sxx", "sqrt(n*1.0/(n-1-2*g)*m)/sxx"), ("l_tax", "0.0*n", None)], BOTH))
def fe_level_and_slope(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + fe(l_suppkey)*l_tax", Robust()))


def _turn(column: str, inner: str) -> str:
    return f"SELECT k, g, h, l, y - avg(y) OVER (PARTITION BY {column}) AS y, x1 - avg(x1) OVER (PARTITION BY {column}) AS x1, x2 - avg(x2) OVER (PARTITION BY {column}) AS x2 FROM ({inner})"


THREE = f"""WITH RECURSIVE s0 AS (SELECT l_suppkey AS g, l_partkey AS h, l_linenumber AS l, l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, count(*) OVER (PARTITION BY l_partkey) AS ch, count(*) OVER (PARTITION BY l_suppkey) AS cg, count(*) OVER (PARTITION BY l_linenumber) AS cl FROM lineitem),
it AS (SELECT 0 AS k, g, h, l, y, x1, x2 FROM s0 WHERE ch > 1 AND cg > 1 AND cl > 1 UNION ALL SELECT k + 1, g, h, l, y, x1, x2 FROM ({_turn('l', _turn('h', _turn('g', 'SELECT * FROM it WHERE k < 40')))})),
d AS (SELECT * FROM it WHERE k = 40),
b AS (SELECT count(*) AS n, count(DISTINCT g)*1.0 AS gg, 1 + count(DISTINCT h) + count(DISTINCT l) AS absorbed, sum(x1*x1) AS s11, sum(x1*x2) AS s12, sum(x2*x2) AS s22, sum(x1*y) AS s1y, sum(x2*y) AS s2y FROM d),
a AS (SELECT *, s11*s22-s12*s12 AS d, (s22*s1y-s12*s2y)/(s11*s22-s12*s12) AS b1, (s11*s2y-s12*s1y)/(s11*s22-s12*s12) AS b2, s22/(s11*s22-s12*s12) AS a11, -s12/(s11*s22-s12*s12) AS a12, -s12/(s11*s22-s12*s12) AS a21, s11/(s11*s22-s12*s12) AS a22 FROM b),
c AS (SELECT d.g, sum(x1*(y-b1*x1-b2*x2)) AS u, sum(x2*(y-b1*x1-b2*x2)) AS v FROM d, a GROUP BY d.g),
z AS (SELECT sum(u*u) AS m11, sum(u*v) AS m12, sum(v*v) AS m22 FROM c),
fit AS (SELECT *, (n-1.0)/(n-2-absorbed)*gg/(gg-1) AS k FROM a, z) """


@query(THREE + f"SELECT 'l_quantity' AS term, {sig_sql('b1')} AS estimate, {sig_sql(SANDWICH.format(i=1))} AS std_error FROM fit UNION ALL SELECT 'l_discount', {sig_sql('b2')}, {sig_sql(SANDWICH.format(i=2))} FROM fit")
def fe_three_way_cluster(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + l_discount + fe(l_suppkey) + fe(l_partkey) + fe(l_linenumber)", Cluster("l_suppkey")))


# ---- further forms --------------------------------------------------------------------------------------------

WEIGHTED = "d AS (SELECT l_suppkey AS k, l_quantity AS w, l_extendedprice - sum(l_quantity*l_extendedprice) OVER s / sum(l_quantity) OVER s AS y, l_discount - sum(l_quantity*l_discount) OVER s / sum(l_quantity) OVER s AS x FROM lineitem WINDOW s AS (PARTITION BY l_suppkey)), fit AS (SELECT count(*) AS n, count(DISTINCT k) AS g, sum(w*x*x) AS sxx, sum(w*x*y) AS sxy, sum(w*y*y) AS syy FROM d)"


@query(term_rows([("l_discount", "sxy/sxx", "sqrt((syy-sxy*sxy/sxx)/(n-1-g)/sxx)")], WEIGHTED))
def fe_weighted(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_discount + fe(l_suppkey)", weights="l_quantity"))


PRODUCT = SLOPE.replace("l_tax*sy", "l_tax*l_discount*sy").replace("l_tax*sx", "l_tax*l_discount*sx").replace("sum(l_tax*l_extendedprice)/sum(l_tax*l_tax)", "sum(l_tax*l_discount*l_extendedprice)/sum(pow(l_tax*l_discount, 2))").replace("sum(l_tax*l_quantity)/sum(l_tax*l_tax)", "sum(l_tax*l_discount*l_quantity)/sum(pow(l_tax*l_discount, 2))")


@query(term_rows([("l_quantity", "sxy/sxx", None)], PRODUCT))
def fe_slope_of_product(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ 0 + l_quantity + fe(l_suppkey)&l_tax&l_discount", drop_singletons=False)).withColumn("std_error", F.lit(None).cast("double"))


@query(term_rows([("is_even", "sxy/sxx", None)], "o AS (SELECT *, CAST(o_custkey % 2 AS DOUBLE) AS is_even FROM orders), " + _within("o_orderstatus, o_orderpriority", "o", "o_totalprice", "is_even") + ", fit AS (SELECT * FROM c, gr)"))
def fe_crossed_keys(spark, sf_dir):
    df = orders(spark, sf_dir).selectExpr("*", "cast(o_custkey % 2 as double) as is_even")
    return terms(spark, reg(df, "o_totalprice ~ is_even + fe(o_orderstatus)*fe(o_orderpriority)")).withColumn("std_error", F.lit(None).cast("double"))


@query(term_rows([("(Intercept)", "a", "sqrt(s2 * (1.0 / n + mx * mx / sxx))"), ("l_quantity", "b", "sqrt(s2 / sxx)")], ONE.format(y="l_extendedprice", x="l_quantity", t="lineitem")))
def explicit_intercept(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ 1 + l_quantity"))


FLAGS = "WITH g AS (SELECT l_returnflag AS f, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem GROUP BY 1), z AS (SELECT * FROM g WHERE f = (SELECT min(f) FROM g)) "


@query(
    FLAGS
    + f"SELECT '(Intercept)' AS term, {sig_sql('a')} AS estimate FROM z UNION ALL SELECT 'l_quantity', {sig_sql('b')} FROM z UNION ALL SELECT 'l_returnflag: ' || g.f, {sig_sql('g.a - z.a')} FROM g, z WHERE g.f <> z.f UNION ALL SELECT 'l_returnflag: ' || g.f || ' & l_quantity', {sig_sql('g.b - z.b')} FROM g, z WHERE g.f <> z.f"
)
def levels_times_slope(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_returnflag*l_quantity")).select("term", "estimate")


@query(f"SELECT 'l_linenumber: ' || l_linenumber || ' & l_quantity' AS term, {sig_sql('sum(l_quantity*l_extendedprice)/sum(l_quantity*l_quantity)')} AS estimate FROM lineitem GROUP BY l_linenumber")
def wide_model(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ 0 + l_linenumber&l_quantity", contrasts={"l_linenumber": Dummy()})).select("term", "estimate")


#: Sums within three clusters leave two degrees of freedom, for which the t distribution has a closed form.
BOUNDS = ONE.format(y="l_extendedprice", x="l_quantity", t="lineitem").replace("fit AS", "o AS") + ", s AS (SELECT sum((l_quantity - mx)*(l_extendedprice - a - b*l_quantity)) AS s FROM lineitem, o GROUP BY l_returnflag), v AS (SELECT sum(s*s) AS m, count(*)*1.0 AS gg FROM s), fit AS (SELECT b, sqrt((n-1.0)/(n-2)*gg/(gg-1)*m)/sxx AS se FROM o, v)"


@query(f"WITH {BOUNDS} SELECT 'l_quantity' AS term, {sig_sql('b')} AS estimate, {sig_sql('se')} AS std_error, round(1 - abs(b/se)/sqrt(2 + b/se*b/se), 6) + 0.0 AS p_value, {sig_sql('b - se*0.95/sqrt(2*0.975*0.025)')} AS conf_low, {sig_sql('b + se*0.95/sqrt(2*0.975*0.025)')} AS conf_high FROM fit")
def coefficient_bounds(spark, sf_dir):
    m = reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity", Cluster("l_returnflag"))
    r = next(r for r in m.coeftable_df(spark).collect() if r.term == "l_quantity")
    return spark.createDataFrame([(r.term, signif(r.estimate), signif(r.std_error), round(r.p_value, 6) + 0.0, signif(r.conf_low), signif(r.conf_high))], "term string, estimate double, std_error double, p_value double, conf_low double, conf_high double")


THREE_KEYS = ["g", "h", "l"]
SIGNED = [(sign, ", ".join(k)) for sign, k in [("+", "g"), ("+", "h"), ("+", "l"), ("-", "gh"), ("-", "gl"), ("-", "hl"), ("+", "ghl")]]


@query(
    term_rows(
        [("l_quantity", "b1", SANDWICH.format(i=1)), ("l_discount", "b2", SANDWICH.format(i=2))],
        f"{LINE2.replace(' FROM lineitem', ', l_linenumber AS l FROM lineitem')}, {TWO}, {INV2.replace('SELECT g, h,', 'SELECT g, h, l,')}, z AS (SELECT "
        + ", ".join("".join(f"{s}p{i}.{m}" for i, (s, _) in enumerate(SIGNED)) + f" AS {m}" for m in ("m11", "m12", "m22"))
        + ", least(p0.gg, p1.gg, p2.gg) AS gg FROM "
        + ", ".join(f"{_two_way(k)} p{i}" for i, (_, k) in enumerate(SIGNED))
        + "), fit AS (SELECT *, (n-1.0)/(n-3)*gg/(gg-1) AS k FROM a, z)",
    )
)
def cluster_three_way(spark, sf_dir):
    return terms(spark, reg(lineitem(spark, sf_dir), "l_extendedprice ~ l_quantity + l_discount", Cluster("l_suppkey", "l_partkey", "l_linenumber"))).where("term <> '(Intercept)'")


OVER = "t AS (SELECT l_extendedprice AS y, l_quantity AS x, l_quantity + 10*l_tax + l_linenumber AS z, l_quantity*l_tax AS q FROM lineitem), m AS (SELECT count(*) AS n, avg(y) AS my, avg(x) AS mx, avg(z) AS mz, avg(q) AS mq FROM t), d AS (SELECT y-my AS y, x-mx AS x, z-mz AS z, q-mq AS q FROM t, m), c AS (SELECT count(*) AS n, sum(z*z) AS zz, sum(z*q) AS zq, sum(q*q) AS qq, sum(z*x) AS zx, sum(q*x) AS qx FROM d), p AS (SELECT n, (qq*zx - zq*qx)/(zz*qq - zq*zq) AS p1, (zz*qx - zq*zx)/(zz*qq - zq*zq) AS p2 FROM c), h AS (SELECT y, x, p1*z + p2*q AS h, n FROM d, p), b AS (SELECT any_value(n) AS n, sum(h*y)/sum(h*x) AS b, sum(h*h) AS hh FROM h), fit AS (SELECT any_value(b.b) AS b, sqrt(sum(pow(y - b.b*x, 2))/(any_value(b.n)-2)/any_value(b.hh)) AS se FROM h, b)"


@query(term_rows([("l_quantity", "b", "se")], OVER))
def iv_over_identified(spark, sf_dir):
    df = lineitem(spark, sf_dir).selectExpr("*", "l_quantity + 10 * l_tax + l_linenumber as z", "l_quantity * l_tax as q")
    return terms(spark, reg(df, "l_extendedprice ~ (l_quantity ~ z + q)")).where("term <> '(Intercept)'")


#: l_quantity is spanned by the instruments and becomes a regressor; the rest is the instrumented slope beside it.
MOVED = "s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS ys, regr_intercept(l_extendedprice, l_quantity) AS yi, regr_slope(l_discount, l_quantity) AS ds, regr_intercept(l_discount, l_quantity) AS di, regr_slope(l_discount + l_tax, l_quantity) AS zs, regr_intercept(l_discount + l_tax, l_quantity) AS zi FROM lineitem), r AS (SELECT l_extendedprice - yi - ys*l_quantity AS y, l_discount - di - ds*l_quantity AS d, l_discount + l_tax - zi - zs*l_quantity AS z FROM lineitem, s), c AS (SELECT count(*) AS n, sum(z*y) AS zy, sum(z*d) AS zd, sum(z*z) AS zz FROM r), fit AS (SELECT any_value(zy/zd) AS b, sqrt(sum(pow(y - zy/zd*d, 2))/(any_value(n)-3)*any_value(zz))/abs(any_value(zd)) AS se FROM r, c)"


@query(term_rows([("l_discount", "b", "se")], MOVED))
def iv_reclassified(spark, sf_dir):
    df = lineitem(spark, sf_dir).selectExpr("*", "2 * l_quantity as twice", "l_discount + l_tax as z")
    return terms(spark, reg(df, "l_extendedprice ~ (l_quantity + l_discount ~ twice + z)")).where("term = 'l_discount'")


CASCADE = "WITH r0 AS (SELECT l_orderkey AS g, l_partkey * 8 + l_linenumber AS h FROM lineitem)" + "".join(f", r{k} AS (SELECT g, h FROM (SELECT g, h, count(*) OVER (PARTITION BY {'gh'[k % 2]}) AS c FROM r{k - 1}) WHERE c > 1)" for k in range(1, 31))


@query(CASCADE + " SELECT 'nobs' AS fact, CAST(count(*) AS DOUBLE) AS value FROM r30 UNION ALL SELECT 'n_singletons', CAST((SELECT count(*) FROM r0) - (SELECT count(*) FROM r30) AS DOUBLE)")
def singletons_cascade(spark, sf_dir):
    df = lineitem(spark, sf_dir).selectExpr("*", "l_partkey * 8 + l_linenumber as cell")
    m = reg(df, "l_extendedprice ~ l_quantity + fe(l_orderkey) + fe(cell)")
    return spark.createDataFrame([("nobs", float(m.nobs)), ("n_singletons", float(m.n_singletons))], "fact string, value double")


@query(f"WITH t AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders) SELECT o_orderkey, round(o_totalprice - a - b * o_custkey, {ROUND}) + 0.0 AS residual FROM orders, t")
def residuals_of_table(spark, sf_dir):
    df = orders(spark, sf_dir)
    return reg(df, "o_totalprice ~ o_custkey").residuals(df).select("o_orderkey", (F.round("residual", ROUND) + 0.0).alias("residual"))


@query(f"SELECT o_orderkey, round(avg(o_totalprice) OVER (), {ROUND}) + 0.0 AS prediction FROM orders")
def predict_constant(spark, sf_dir):
    df = orders(spark, sf_dir)
    return reg(df, "o_totalprice ~ 1").predict(df).select("o_orderkey", (F.round("prediction", ROUND) + 0.0).alias("prediction"))


@query(f"WITH {IV} SELECT l_orderkey, l_linenumber, round(my - b*mx + b*l_quantity, {ROUND}) + 0.0 AS prediction FROM lineitem, fit")
def predict_iv(spark, sf_dir):
    df = lineitem(spark, sf_dir).selectExpr("*", "l_quantity + 10 * l_tax + l_linenumber as z")
    return reg(df, "l_extendedprice ~ (l_quantity ~ z)").predict(df).select("l_orderkey", "l_linenumber", (F.round("prediction", ROUND) + 0.0).alias("prediction"))


TURNED = "WITH RECURSIVE it AS (SELECT 0 AS k, o_orderkey, o_orderpriority AS g, o_orderstatus AS h, o_totalprice AS y FROM orders UNION ALL SELECT k + 1, o_orderkey, g, h, y - avg(y) OVER (PARTITION BY h) FROM (SELECT k, o_orderkey, g, h, y - avg(y) OVER (PARTITION BY g) AS y FROM it WHERE k < 40))"


@query(TURNED + f" SELECT o_orderkey, round(o_totalprice - y, {ROUND}) + 0.0 AS prediction FROM it JOIN orders USING (o_orderkey) WHERE k = 40")
def predict_two_effects(spark, sf_dir):
    df = orders(spark, sf_dir)
    return reg(df, "o_totalprice ~ fe(o_orderpriority) + fe(o_orderstatus)", save="fe").predict(df).select("o_orderkey", (F.round("prediction", ROUND) + 0.0).alias("prediction"))


@query(f"WITH t AS (SELECT *, 1.0 + o_custkey % 3 AS w FROM orders) SELECT o_orderkey, round(o_totalprice - sum(w*o_totalprice) OVER p / sum(w) OVER p, {ROUND}) + 0.0 AS resid_o_totalprice, round(o_custkey - sum(w*o_custkey) OVER p / sum(w) OVER p, {ROUND}) + 0.0 AS resid_o_custkey FROM t WINDOW p AS (PARTITION BY o_orderpriority)")
def partial_out_weighted(spark, sf_dir):
    df = orders(spark, sf_dir).selectExpr("*", "1.0D + o_custkey % 3 as w")
    out = partial_out(df, "o_totalprice + o_custkey ~ fe(o_orderpriority)", weights="w")
    return out.df.select("o_orderkey", *((F.round(c, ROUND) + 0.0).alias(c) for c in ("resid_o_totalprice", "resid_o_custkey")))
