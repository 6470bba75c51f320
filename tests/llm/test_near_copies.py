import random

import corpus_pipeline as cp
import pytest

from panelspark.llm import simhash

STAGE = dict(cp.STAGES)["near_duplicates"]
SCHEMA = "doc_id long, text string, source string"


def brute_sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_groups(rows):
    sets = [brute_sets(t) for _, t, *_ in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if comp[i] > comp[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    comp[i], changed = comp[j], True
    return comp


def planted(n=40, seed=4):
    """Texts, each with a copy whose likeness lies anywhere from 0.6 to 1."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([40, 150, 700]))]
        rows.append((i, " ".join(words), "s"))
        for _ in range(rnd.randrange(len(words) // 45 + 2)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(5000)}"
        rows.append((1000 + i, "\n".join(words), "t"))
    return rows


def test_the_stage_finds_planted_pairs_from_0_8(spark):
    rows = planted() + [(5000, None, "n"), (5001, " ", "n"), (5002, "One two", "n"), (5003, "one  two", "n")]
    near = [likeness(brute_sets(rows[k][1]), brute_sets(rows[k + 1][1])) for k in range(0, 80, 2)]
    assert sum(0.8 <= x < 0.95 for x in near) >= 10 and sum(x < 0.8 for x in near) >= 5
    comp = brute_groups(rows)
    got = STAGE(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted(r.doc_id for r in got.collect()) == sorted(rows[c][0] for c in set(comp))


def test_groups_of_many_members(spark):
    """Chains and crowds round one text: keys with many members that their first member does not reach."""
    rnd = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(0, 100)
            words[at : at + rnd.randrange(1, 6)] = [f"y{rnd.randrange(10**6)}"]
        rows.append((i, " ".join(words), "s"))
    comp = brute_groups(rows)
    assert len(set(comp)) > 3
    got = simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    group = {r.doc_id: r.group for r in got}
    assert len(got) == len(rows) and len(set(group.values())) == len(set(comp))
    assert len({(group[i], comp[i]) for i in range(len(rows))}) == len(set(comp))


@pytest.mark.parametrize("rows", [1, 50_000, 10**7, 10**10])
def test_segments_miss_few_pairs_at_the_bound(rows):
    import numpy as np

    rng = np.random.default_rng(3)
    half, number = simhash.cut(rows)
    longs = -(-2 * half * number // 64)
    assert longs >= simhash.SKETCH and 2 * half >= np.log2(rows) + 2
    missed = far = 0
    for _ in range(300):
        x = rng.integers(0, 2**64, 180, dtype=np.uint64)
        a, b = np.sort(x[:162]), np.sort(x[18:])
        assert simhash.alike(a, b) and not simhash.alike(np.sort(x[:160]), b)
        raw = [np.frombuffer(simhash.wide(y, longs), np.uint64) for y in (a, b)]
        bits = np.unpackbits((raw[0] ^ raw[1]).view(np.uint8), bitorder="little")[: 2 * half * number]
        missed += bits.reshape(number, -1).sum(axis=1).min() > 1
        far += np.bitwise_count(raw[0] ^ raw[1])[: simhash.SKETCH].sum() > simhash.reach()
    assert missed <= 6 and far <= 1


def test_a_crowd_over_the_block(spark, monkeypatch):
    """Half segments of more members than a block, by number and by length, and crowds and pairs in many tasks."""
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base), "s")]
    for i in range(1, 120):
        words = list(base)
        for at in rnd.sample(range(0, 115, 6), rnd.randrange(1, 4)):
            words[at] = f"y{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words), "s"))
    comp = brute_groups(rows)
    monkeypatch.setattr(simhash, "SMALL", 4)
    monkeypatch.setattr(simhash, "CROWD", 32)
    monkeypatch.setattr(simhash, "HELD", 2000)
    monkeypatch.setattr(simhash, "BUCKET", 40_000)
    group = {r.doc_id: r.group for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(set(group.values())) == len(set(comp)) == len({(group[i], comp[i]) for i in range(len(rows))})


def test_a_set_travels_once(spark, monkeypatch):
    """Members of many crowds and pairs: their sets go to one place, where all links of their cluster are found."""
    rnd = random.Random(3)
    rows = []
    for k in range(4):
        base = [f"w{rnd.randrange(5000)}" for _ in range(150)]
        for i in range(30):
            words = list(base)
            for at in rnd.sample(range(150), rnd.randrange(1, 4)):
                words[at] = f"x{rnd.randrange(10**6)}"
            rows.append((100 * k + i, " ".join(words), "s"))
    rows += rows[:20]
    came, crowd, decide = spark.sparkContext.accumulator(0), simhash._crowd, simhash._decide

    def counted(members):
        came.add(members.num_rows)
        return crowd(members)

    def decided(sets, pairs):
        came.add(sets.num_rows)
        return decide(sets, pairs)

    monkeypatch.setattr(simhash, "_crowd", counted)
    monkeypatch.setattr(simhash, "_decide", decided)
    group = {(r.doc_id, r.h1): r.group for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(1)).collect()}
    assert len(group) == 120 and len(set(group.values())) == len(set(brute_groups(rows)))
    assert 100 < came.value <= 120


def test_what_goes_with_a_half_misses_few_pairs():
    import numpy as np

    rng = np.random.default_rng(4)
    far = 0
    for _ in range(1000):
        x = rng.integers(0, 2**64, 180, dtype=np.uint64)
        raw = [np.frombuffer(simhash.wide(np.sort(y), simhash.SENT), np.uint64) for y in (x[:162], x[18:])]
        far += np.bitwise_count(raw[0] ^ raw[1]).sum() > simhash.reach(simhash.SENT)
    assert far <= 3


def test_a_forest_joins_what_links_join(spark, monkeypatch):
    """Many links between few ends are cut to fewer than the ends before components are sought."""
    from panelspark.llm.components import connected_components

    rnd = random.Random(6)
    rows = [(100 * k + rnd.randrange(40), 100 * k + rnd.randrange(40)) for k in range(5) for _ in range(400)] + [(900, 901), (7000, 7000)]
    links = spark.createDataFrame(rows, "a long, b long").coalesce(1)
    cut = links.mapInArrow(simhash._forest, "a long, b long")
    assert cut.count() < len({x for r in rows for x in r})
    assert sorted(connected_components(cut).collect()) == sorted(connected_components(links).collect())


def test_empty_table(spark):
    assert STAGE(spark, spark.createDataFrame([], SCHEMA), "").collect() == []


@pytest.mark.parametrize("stage", [STAGE, cp.keep_one_of_each_group])
def test_rows_are_decided_one_by_one(spark, stage):
    rnd = random.Random(5)
    a, b, c = (" ".join(f"w{rnd.randrange(5000)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a, "s"), (7, a, "s"), (7, b, "s"), (7, b, "t"), (None, c, "s"), (None, c, "s"), (None, a, "s"), (9, None, "s")]
    got = [(r.doc_id, r.text) for r in stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    assert sorted(got, key=str) == sorted([(1, a), (7, b), (None, c), (9, None)], key=str)
