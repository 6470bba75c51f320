import hashlib
import random
import re

from pyspark.sql import functions as F

from panelspark.llm import fingerprint as fp

SCHEMA = "doc_id long, text string, next string, key string, fingerprint string"


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_edits_and_likeness(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("ab cd ef Gh ïj kl".split()) + str(rnd.randrange(40)) for _ in range(n)) for n in (1, 4, 5, 6, 30, 300, 900, 2000, 2, 700)]
    rows = [(3 * i - 7, t) for i, t in enumerate(texts)] + [(100, None), (101, ""), (102, "é" * 5), (103, texts[5]), (104, texts[5] + " one more"), (105, " \n")]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "n", "k", "f") for i, t in rows], SCHEMA)
    order = sorted(rows)
    for buckets in (1, 4, 50):
        got = {r.doc_id: r for r in fp.fingerprints(docs, buckets).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(order):
            t, after = t or "", order[(k + 1) % len(order)][1] or ""
            half = len(t) // 2
            changed = t[: len(t) - half] + after[:half]
            r = got[i]
            assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest(), (i, buckets)
            assert len(r.fingerprint) == len(r.edited_fingerprint) == 2 * fp.BINS
            for near, a, b in ((r.near_edited, t, changed), (r.near_next, t, after)):
                a, b = shingles(a), shingles(b)
                true = len(a & b) / len(a | b) if a | b else 1.0
                assert abs(near - true) < 0.16, (i, near, true)
    assert got[103].fingerprint == next(r for i, r in got.items() if dict(rows)[i] == texts[5] and i < 100).fingerprint


def test_densified_bins_keep_the_likeness(spark):
    """Few shingles leave most bins empty; likeness is then still unbiased on average."""
    rnd = random.Random(2)
    pairs = []
    for _ in range(60):
        a = [str(rnd.randrange(10**6)) for _ in range(24)]
        b = a[:18] + [str(rnd.randrange(10**6)) for _ in range(6)]
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select(fp.fingerprint(F.col("a")).alias("a"), fp.fingerprint(F.col("b")).alias("b"))
    got = [r[0] for r in df.select(fp.likeness(F.col("a"), F.col("b"))).collect()]
    true = sum(len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs) / len(pairs)
    assert abs(sum(got) / len(got) - true) < 0.05


def test_odd_tables(spark):
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fp.fingerprints(spark.createDataFrame([(7, "abcd", "", "", "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one[0].near_next == 1
    same = fp.fingerprints(spark.createDataFrame([(7, "abcd", "", "", "")] * 3 + [(None, "xyz", "", "", ""), (9, "q" * 90_000 + " w", "", "", "")], SCHEMA)).collect()
    assert len(same) == 5


def plain_fingerprint(text):
    """The fingerprint by the docstring, in plain Python."""
    import struct

    import xxhash

    seeded = lambda numbers: __import__("functools").reduce(lambda seed, h: xxhash.xxh64_intdigest(struct.pack("<Q", h), seed), numbers, 42)
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    cut = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    least = {}
    for h in map(seeded, cut):
        least[h >> 57] = min(h, least.get(h >> 57, h))
    if not least:
        return "00" * 128
    bins = []
    for b in range(128):
        order = sorted((j for j in range(128) if j != b), key=lambda j: fp._mix(b, j))
        bins.append(next(least[j] for j in [b, *order] if j in least))
    return "".join(f"{v & 255:02x}" for v in bins)


def test_every_digit_against_plain_python(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("ab cd ef Gh ïj kl Über".split()) + str(rnd.randrange(60)) for _ in range(n)) for n in (1, 2, 4, 5, 6, 7, 20, 90, 400, 3000, 20000)]
    texts += [None, "", " \n\t", "one", "A a A a A a A a A a", "\x0b tab\x0cand\x0dfeeds  twice\x1f not blank", "語 " * 50]
    rows = [(i, t, "n", "k", "f") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, SCHEMA), 3).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        assert got[i].fingerprint == plain_fingerprint(t), i
        assert got[i].edited_fingerprint == plain_fingerprint(t[: len(t) - half] + after[:half]), i
