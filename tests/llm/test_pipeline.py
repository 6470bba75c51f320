import zlib

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from panelspark.llm import pieces, pii, quality
from panelspark.llm.queries import tokenizer_path

from .test_simhash import brute_components, brute_print


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A few hundred documents: good and bad ones, copies, near copies, personal data, uneven sources."""
    import numpy as np

    rng = np.random.default_rng(9)
    vocab = [a + b + c for a in "ba ce di fo gu ha".split() for b in "lo mi ta re vi po".split() for c in "n s r".split()]
    rows, labels = [], []
    for i in range(400):
        words = list(rng.choice(vocab, rng.integers(30, 120)))
        good = int(i % 5 != 0)
        text = " ".join(words).capitalize() + "." if good else "$$$ ".join(words)
        if i % 11 == 0 and good:
            text += " Mail me at some.one@host.example or +1 (234) 567-8901."
        rows.append((i, text, "en", "big" if i % 4 else f"s{i % 3}"))
        if i % 3 != 1:
            labels.append((i, good, 0))
        if i % 10 == 3:
            rows.append((1000 + i, text, "en", "big"))
        if i % 10 == 7:
            rows.append((2000 + i, text + " end", "en", "s1"))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def test_stages_one_by_one(spark, folder):
    path, rows, labels = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    good = cp.keep_good(spark, docs, path)
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    model = quality.fit(docs, quality.training_rows(spark.read.parquet(f"{path}/labels.parquet")))
    import numpy as np

    assert kept == {i for i, t, *_ in rows if model.score(np.array([quality.features(t)]))[0] >= quality.CUT}
    assert sum((i in kept) == q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0) >= 0.95 * sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in labels)
    one = cp.keep_one_of_each_group(spark, good, path)
    assert one.columns == columns
    comp = brute_components({r.doc_id: brute_print(r.text) for r in good.collect()})
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, c in comp.items() if i == c)
    clean = cp.hide_personal_data(spark, one, path)
    assert clean.columns == columns and dict(clean.dtypes) == dict(docs.dtypes)
    for r in clean.collect():
        assert not pii.spans(r.text) and r.n_chars == len(r.text)
    mixed = cp.mix_sources(spark, clean, path)
    assert mixed.columns == columns
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in clean.collect()}
    assert mixed.count() > clean.count()


def test_whole_run(spark, folder):
    path, rows, _ = folder
    got = cp.run(spark, path).collect()
    lib = pieces.Pieces(path=tokenizer_path()).library
    text = {i: t for i, t, *_ in rows}
    assert all(r.n_tokens == len(lib.encode(pii.redact(text[r.doc_id]))) for r in got)
    assert len({r.doc_id for r in got}) < len(got)


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_and_nulls(spark, folder):
    schema = "doc_id long, text string, source string, score double, component_id long, fingerprint string, mix_key double, kept_id long"
    docs = spark.createDataFrame([(i, t, s, 0.5, 7, "f", 0.1, 3) for i, t, s in [(1, "a b", "s"), (1, "a b", "s"), (2, None, None), (None, "c d", "s")]], schema)
    for _, stage in cp.STAGES[2:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {(r.score, r.component_id, r.fingerprint, r.mix_key, r.kept_id) for r in out.collect()} == {(0.5, 7, "f", 0.1, 3)}
    assert cp.keep_one_of_each_group(spark, docs, "").columns == docs.columns
    assert sorted((r.doc_id or 0) for r in cp.keep_one_of_each_group(spark, docs, "").collect()) == [0, 1, 2]
