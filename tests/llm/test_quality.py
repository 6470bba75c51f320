import math
import zlib

import numpy as np

from panelspark.llm import quality

SCHEMA = "doc_id long, text string, score double, predicted int"


def corpus(n=300, seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = rng.choice("alpha beta gamma delta eps zeta eta theta".split(), rng.integers(8, 60))
        good = int(i % 4 != 0)
        text = " ".join(words).capitalize() + "." if good else "$$$ ".join(words) if i % 8 else "!! ".join(words).upper() + "!!"
        rows.append((i, text, good))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, 0.1, 7) for i, t, _ in rows], SCHEMA)
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    rows = corpus() + [(1000, None, None), (1001, "", None), (1002, "Alpha beta gamma. " * 9000, None), (None, "Alpha beta.", 1)]
    docs, labels = frames(spark, rows)
    got = quality.held_out(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by.items() if i is not None)
    unseen = [(by[i].predicted, q) for i, _, q in corpus() if by[i].held_out]
    assert sum(a == b for a, b in unseen) >= 0.95 * len(unseen)


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows = corpus(120)
    docs, labels = frames(spark, rows)
    flipped = [(i, t, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, t, q in rows]
    a = quality.held_out(docs, labels).orderBy("doc_id").collect()
    b = quality.held_out(docs, frames(spark, flipped)[1]).orderBy("doc_id").collect()
    assert a == b


def test_nothing_to_learn_from(spark):
    docs, labels = frames(spark, [(1, "a b", 1), (2, "c d", 1)])
    assert {r.score for r in quality.held_out(docs, labels).collect()} == {0.5}
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.held_out(empty, labels).collect() == []


def test_scores_follow_preferences():
    rows = corpus()
    x, y = np.array([quality.features(t) for _, t, _ in rows]), np.array([q for *_, q in rows])
    s = quality.Model(x, y).score(x)
    assert s[y == 1].min() > s[y == 0].max()


def test_scores_by_plain_python(spark):
    """Scores of a query from the fitted numbers, feature by feature without arrays; whatever partitions rows are in."""
    rows = corpus(160) + [(900, None, None), (901, "", None), (902, "No end " * 30_000, None)]
    docs, labels = frames(spark, rows)
    model = quality.fit(docs, quality.training_rows(labels))
    got = {r.doc_id: r.score for r in quality.scores(docs.repartition(5), model).collect()}
    for i, text, _ in rows:
        z = [min(6.0, max(-6.0, (x - c) / s)) for x, c, s in zip(quality.features(text), model.centre, model.scale, strict=True)]
        hinges = [max(x - k, 0.0) for knots in model.knots for x, k in zip(z, knots, strict=True)]
        s = (sum(x * w for x, w in zip([*z, *hinges], model.weights, strict=True)) - model.cut) / model.spread
        odds = 2 * s + math.log(0.3 / 0.7)
        assert abs(got[i] - 1 / (1 + math.exp(-min(500.0, max(-500.0, odds))))) < 1e-9
