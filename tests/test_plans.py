"""What the plans of the estimator read and do."""

import os
import re

import pytest

from panelspark import Robust, reg
from panelspark.operators import absorb, covariance, moments

PATH = "/root/testdata/sf0.001/lineitem.parquet"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the tables are not here")


@pytest.fixture
def seen(monkeypatch):
    """The plans of all products that are summed."""
    plans = []
    real = moments.cross

    def spy(df, columns, *args, **kwargs):
        plans.append(df.select("*", *(c.alias(f"z{i}") for i, c in enumerate(columns))).agg(*[moments.F.sum(f"z{i}") for i in range(len(columns))])._jdf.queryExecution().executedPlan().toString())
        return real(df, columns, *args, **kwargs)

    from panelspark.plans import estimate

    for module in (absorb, covariance, estimate):
        monkeypatch.setattr(module, "cross", spy)
    return plans


def test_scans_read_what_is_needed(spark, seen):
    df = spark.read.parquet(PATH)
    reg(df, "l_extendedprice ~ l_quantity", Robust(), subset="l_tax > 0.02")
    assert len(seen) == 2
    for plan in seen:
        schema = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
        assert {c.split(":")[0] for c in schema.split(",")} == {"l_extendedprice", "l_quantity", "l_tax"}
        assert "GreaterThan(l_tax" in plan and "IsNotNull(l_quantity)" in plan
        assert not re.search("Python|Pandas|Arrow|Window|Cartesian|NestedLoop", plan)


def test_effects_need_no_row_join_for_conventional_errors(spark, seen):
    df = spark.read.parquet(PATH)
    reg(df, "l_extendedprice ~ l_quantity + fe(l_suppkey)")
    reg(df, "l_extendedprice ~ l_quantity + fe(l_suppkey) + fe(l_partkey)")
    assert not any(re.search("Join|Window|Python|Pandas", p) for p in seen)


def test_row_outputs_join_groups_only(spark):
    df = spark.read.parquet(PATH)
    m = reg(df, "l_extendedprice ~ l_quantity + fe(l_suppkey)", save="all")
    plan = m.residuals()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "SortMergeJoin" not in plan and "Window" not in plan
