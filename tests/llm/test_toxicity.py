import zlib

import numpy as np

from panelspark.llm import toxicity

SCHEMA = "doc_id long, text string, score double, held_out string"


def corpus(n=500, seed=3):
    rng = np.random.default_rng(seed)
    vocab = [a + b for a in "ba ce di fo gu ha".split() for b in "lor min tas ren vik pos".split()]
    rows = []
    for i in range(n):
        toxic = int(i % 5 == 0)
        words = list(rng.choice(vocab, rng.integers(20, 80)))
        if toxic:
            for k in rng.choice(len(words), 5, replace=False):
                words[k] = rng.choice(["zarqol", "zarqomi", "zarqet"]) if i % 2 else rng.choice(["idiot", "scum", "moron"])
        rows.append((i, " ".join(words), toxic))
    return rows


def frames(spark, rows):
    return spark.createDataFrame([(i, t, 9.0, "x") for i, t, _ in rows], SCHEMA), spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_held_out_rows_are_told_apart(spark):
    rows = corpus() + [(1000, None, None), (1001, "", None), (1002, "balor cemin you " * 9000, None), (None, "you idiot", 1), (1, corpus()[1][1], 0)]
    docs, labels = frames(spark, rows)
    got = toxicity.held_out(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in by.items() if i is not None)
    unseen = [(by[i].predicted, y) for i, _, y in corpus() if by[i].held_out]
    assert sum(a == b for a, b in unseen) >= 0.97 * len(unseen)
    assert by[1002].predicted == 0 and by[1001].predicted == 0


def test_nothing_to_learn_from(spark):
    docs, labels = frames(spark, [(1, "a b", 1), (2, "c d", 1)])
    assert {r.score for r in toxicity.held_out(docs, labels).collect()} == {0.0}
    assert toxicity.held_out(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    s = rng.normal(size=300).round(1)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * s))).astype(float)
    steps, chance = toxicity.isotonic(s, y)
    assert (np.diff(steps) > 0).all() and (np.diff(chance) >= 0).all() and (0 < chance).all() and (chance < 1).all()


def test_trees_fit_a_rule_of_two_features():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 4))
    y = ((x[:, 1] > 0.5) & (x[:, 3] > 0.3)).astype(int)
    raw = toxicity.Trees(x[:1500], y[:1500]).raw(x[1500:])
    assert ((raw > 0) == y[1500:]).mean() > 0.97


def test_windows():
    assert toxicity._densest([]) == 0 and toxicity._densest([1, 2, 3, 40]) == 3


def test_capitals_count_alike_at_every_length():
    none = toxicity.Lexicon({}, {})
    for text in ("ŠКΣA", "Šk Кот Σa bc "):
        assert abs(toxicity.features(text * 10, none)[14] - toxicity.features(text * 1000, none)[14]) < 1e-12
    assert toxicity.features("ŠК" * 2000, none)[14] == 1
