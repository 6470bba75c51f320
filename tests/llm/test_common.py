import zlib

from panelspark.llm import common


def test_samples_are_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(i % 7, f"text {i}") for i in range(200)] + [(8, None), (None, "x"), (9, "long" * 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 10, i % 2) for i in range(60)] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = common.labelled_sample(docs, labels, "quality", 5, 100).collect()
    assert len(got) <= 5 and len({r.doc_id for r in got}) == len(got)
    every = common.labelled_sample(docs, labels, "quality", 100, 100).collect()
    assert {r.doc_id for r in every} == set(range(7)) and all(r.label == r.doc_id % 2 for r in every)
    assert {r.doc_id for r in got} <= {r.doc_id for r in every}


def test_remainders(spark):
    df = spark.createDataFrame([(5,), (None,), (-3,)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", common.remainder("doc_id", 4)).collect()}
    assert got == {5: zlib.crc32(b"5") % 4, -3: zlib.crc32(b"-3") % 4, None: 0}


def test_batches_of_any_length(spark):
    df = spark.range(1000).selectExpr("id", "cast(id as string) as text", "id % 3 as k")
    make = lambda: lambda texts, ks: {"n": [len(t) + k for t, k in zip(texts, ks, strict=True)]}
    got = df.select("id", common.over_texts(make, "n long", "text", "k")["n"].alias("n")).collect()
    assert all(r.n == len(str(r.id)) + r.id % 3 for r in got) and len(got) == 1000


def test_a_worker_lets_go_what_is_not_asked_for():
    common.kept("old", dict)
    f = common.started(lambda: common.kept("new", lambda: 5))
    assert f == 5 and set(common.KEPT) == {"new"}
    common.started(lambda: None)
    assert not common.KEPT
