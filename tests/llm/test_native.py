"""The operators that are to be native run no Python on executors, and null ids have a defined result."""

import re

from panelspark.llm import fingerprint, mixing, simhash

SCHEMA = "doc_id long, text string, source string"


def test_native_plans(spark):
    docs = spark.createDataFrame([(i, f"some words here {i} and more of them", f"s{i % 2}") for i in range(20)], SCHEMA)
    for df in (fingerprint.fingerprints(docs), mixing.mix(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    # the text is shuffled once
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rows_without_an_id(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text, "s"), (5, text, "s"), (3, text, "s"), (None, "alone " * 9, "s")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(3, 3), (5, 3), (None, 3), (None, None)]
