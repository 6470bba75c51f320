import hashlib
import os
import random

import pytest

from panelspark.llm import pieces
from panelspark.llm.queries import tokenizer_path

PATH = tokenizer_path()
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="the vocabulary file is not here")
SCHEMA = "doc_id long, text string, ids string, n_tokens string"


def odd_texts(n=3000):
    rnd = random.Random(4)
    bits = [*"ab  \n\t.é<>s/unk0x41▁😀\x00", "the", "<s>", " and", " " * 7, "한", "\u0301", ""]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(60))) for _ in range(n)] + ["", "▁", " ", " " * 500, "\n", "\nx", "aaaa" * 3000, "the" * 2000, "�", "supercalifragilisticexpialidocious" * 2]


def test_same_ids_and_texts_as_the_library():
    p = pieces.Pieces(path=PATH)
    texts = odd_texts()
    theirs = p.library.encode(texts)
    got = p.digests(texts)
    for k, (t, ids) in enumerate(zip(texts, theirs, strict=True)):
        assert got["n_tokens"][k] == len(ids)
        assert got["ids_sha256"][k] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"][k] == hashlib.sha256(p.library.decode(ids).encode()).hexdigest()
        if k % 7 == 0:
            assert p.encode(t) == ids and p.decode(ids) == p.library.decode(ids)


def test_side_by_side_merges_equal_the_agenda():
    p = pieces.Pieces(path=PATH)
    parts = [x for x in {q.replace(" ", pieces.MARK) for t in odd_texts(800) for q in p.parts(t)} if len(x) <= pieces.SHORT and p.single.keys() >= set(x)]
    assert p.merge_all(parts) == [p.encode_part(x) for x in parts]


def test_decoding_any_ids():
    p, rnd = pieces.Pieces(path=PATH), random.Random(9)
    for _ in range(1500):
        ids = [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(0, 259) for _ in range(rnd.randrange(12))]
        ids = [i for i in ids if i != 0]
        assert p.decode(ids) == p.library.decode(ids), ids


def test_a_difference_is_raised_and_parts_are_let_go(monkeypatch):
    p = pieces.Pieces(path=PATH)
    monkeypatch.setattr(pieces, "HELD", 40)
    texts = odd_texts(300)
    want = pieces.Pieces(path=PATH).digests(texts)
    for at in range(0, len(texts), 10):
        part = p.digests(texts[at : at + 10])
        assert part["ids_sha256"] == want["ids_sha256"][at : at + 10]
    monkeypatch.setattr(p, "merge_all", lambda parts: [[5] for _ in parts])
    with pytest.raises(ValueError, match="differs"):
        p.learn([" house"])


def test_table(spark):
    rows = [(1, "The house", "x", "y"), (2, None, "x", "y"), (3, "", None, None), (1, "The house", "x", "y"), (None, "é" * 30_000, "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    lib = pieces.Pieces(path=PATH).library
    got = pieces.tokens(df, PATH).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(lib.encode(t or "")) for _, t, _, _ in rows)
    assert {r.doc_id: r.ids for r in pieces.encoded(df, PATH).collect()} == {i: lib.encode(t or "") for i, t, _, _ in rows}
    assert pieces.tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []
