import random

import numpy as np
import xxhash

from panelspark.llm import simhash

SCHEMA = "doc_id long, text string, fingerprint string, key string"


def brute_print(text):
    words = []
    for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" "):
        words += [w] if w else []
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints):
    ids = sorted(prints)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if comp[i] > comp[j] and bin(prints[i] ^ prints[j]).count("1") <= 4:
                    comp[i], changed = comp[j], True
    return comp


def test_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["Ää", "the", "of", "IN", "x1", "naïve", " nb", "zz"] + [f"w{i}" for i in range(80)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One two"), (4, "a b c d"), (5, "a b c d e")]
    for i in range(6, 60):
        words = [rnd.choice(vocab) for _ in range(rnd.choice([3, 9, 120]))]
        rows.append((i, " ".join(words)))
        if i % 3 == 0 and len(words) > 100:
            words[rnd.randrange(len(words))] = "changed"
        if i % 3 == 0:
            rows.append((i + 100, "\n".join(words)))
    rows.append((500, "tail word " * 3000))
    rows += rows[10:14]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {i: brute_print(t) for i, t in rows}
    comp = brute_components(prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{p:016x}", comp[i]) for i, p in prints.items()}
    assert len({*comp.values()}) < len(comp) - 5


def test_links_in_every_form_of_group(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = []
    for b in base[:4]:  # dense groups, over the small size and over the block size used here
        for _ in range(60):
            flips = rng.choice(64, rng.integers(0, 4), replace=False)
            prints.append(int(b) ^ sum(1 << int(f) for f in flips))
    prints = sorted({*prints, *map(int, base), 0, 2**64 - 1})
    df = spark.createDataFrame([(p - 2**64 if p >> 63 else p, i) for i, p in enumerate(prints)], "fingerprint long, rep long")
    want = brute_components(dict(enumerate(prints)))
    for block in (4096, 16):
        links = [(r.a, r.b) for r in simhash.near_links(df, block=block).collect()]
        assert all(bin(prints[a] ^ prints[b]).count("1") <= 4 for a, b in links)
        comp = {i: i for i in range(len(prints))}
        for _ in range(len(prints)):
            for a, b in links:
                comp[a] = comp[b] = min(comp[a], comp[b])
        assert comp == want


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
