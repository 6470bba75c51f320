import zlib

import numpy as np

from panelspark.llm import langid

SCHEMA = "doc_id long, text string, lang string, source string, score double"
STEMS = {"aa": "the of and with from that this".split(), "bb": "der die und mit von das nicht".split(), "cc": "el los con una para que más".split()}


def corpus(n=240, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(STEMS)[i % 3]
        rows.append((i, " ".join(rng.choice(STEMS[lang], rng.integers(3, 40))), lang))
    return rows


def test_pieces_of_long_texts_add_up():
    rows = corpus()
    model = langid.train([t for _, t, _ in rows], [x for _, _, x in rows])
    texts = ["the of " * 5000, "x", "mit von das " * 999, "él"]
    whole = model.logits(texts)
    assert np.allclose(whole, model.logits(texts, piece=64))
    one = [langid.grams(langid.folded(t))[0] for t in texts]
    for z, slots in zip(whole, one, strict=True):
        want = model.table[:, slots].mean(axis=1, dtype=float) + model.bias if len(slots) else model.bias
        assert np.allclose(z, want, atol=1e-4)


def test_held_out_accuracy_and_odd_rows(spark):
    rows = [(i, t, x, "s", 0.5) for i, t, x in corpus()] + [(900, None, "aa", None, None), (901, "", None, "s", 1.0), (902, "123 !!", "bb", "s", 1.0), (903, "the " * 40_000, None, "s", 1.0), (0, corpus()[0][1], "aa", "s", 0.1)]
    got = langid.held_out(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r for r in got}
    for i in (900, 901, 902):
        assert (by[i].lang_pred, by[i].score, by[i].accepted) == ("und", 0.0, False)
    assert by[903].lang_pred == "aa"
    unseen = [(by[i].lang_pred, x) for i, _, x in corpus() if by[i].held_out]
    assert sum(a == b for a, b in unseen) >= 0.95 * len(unseen)
    assert all(0 <= r.score <= 1 for r in got)


def test_nothing_to_learn_from(spark):
    assert langid.held_out(spark.createDataFrame([], SCHEMA)).collect() == []
    got = langid.held_out(spark.createDataFrame([(1, "abc", None, None, None)], SCHEMA)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
