import math
import struct
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from panelspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, mix_key string, tokens string"


def corpus():
    rows, k = [], 0
    for source, n in (("big", 2600), ("mid", 700), ("low", 240), (None, 60)):
        for i in range(n):
            rows.append((k, "w " * (1 + (i * 7) % 23), source, "x", "y"))
            k += 1
    return rows


def exponent(tokens, entropy, repeats):
    """By a fine scan in plain floating point."""
    p = [t / sum(tokens.values()) for t in tokens.values()]

    def share(a):
        w = [x**a for x in p]
        w = [x / sum(w) for x in w]
        return -sum(x * math.log(x) for x in w) / math.log(len(w)), max(x / y for x, y in zip(w, p)) / min(x / y for x, y in zip(w, p))

    grid = [i / 200_000 for i in range(200_001)]
    a = max((g for g in grid if share(g)[0] >= entropy), default=0.0)
    return max(a, min(g for g in grid if share(g)[1] <= repeats))


def test_weights_meet_entropy_and_repeats(spark):
    rows = corpus()
    sizes = spark.createDataFrame([(s, len(t.split())) for _, t, s, *_ in rows], "source string, n_tokens long")
    tokens = Counter()
    for _, t, s, *_ in rows:
        tokens[s] += len(t.split())
    for entropy, repeats in ((0.8, 100.0), (0.99, 3.0), (0.5, 9.0)):
        a = exponent(tokens, entropy, repeats)
        got = {r.source: r for r in mixing.plan(sizes, entropy, repeats).collect()}
        z = sum(t**a for t in tokens.values())
        for s, t in tokens.items():
            assert abs(got[s].weight - t**a / z) < 1e-4 and got[s].tokens == t
        assert abs(min(r.epochs for r in got.values()) - 1) < 1e-9
        assert max(r.epochs for r in got.values()) <= repeats + 1e-6


def test_allotments_and_order(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    size = {i: len(t.split()) for i, t, *_ in rows}
    for budget in (None, 30_000, 5000):
        got = mixing.mix(docs, 0.95, 4.0, budget).collect()
        plan = {r.source: r for r in mixing.plan(docs.select("source", mixing.n_tokens(F.col("text")).alias("n_tokens")), 0.95, 4.0, budget).collect()}
        read, times = Counter(), defaultdict(Counter)
        for r in got:
            read[r.source] += size[r.doc_id]
            times[r.source][r.doc_id] += 1
            assert r.mix_key is not None and 0 <= r.mix_key <= 1
        for s, p in plan.items():
            want = p.epochs * p.tokens
            assert want - 1e-6 <= read[s] <= want + 23, (s, budget)  # the last row is read whole
            full = math.floor(p.epochs)
            n = len([1 for r in rows if r[2] == s])
            counts = [times[s][r[0]] for r in rows if r[2] == s]
            assert min(counts) >= full and max(counts) <= math.ceil(p.epochs) and len(counts) == n
        if budget is None:
            assert {r.doc_id for r in got} == {r[0] for r in rows}
        # any stretch of the order holds the sources near their weights
        half = sum(size[r.doc_id] for r in got if r.mix_key < 0.5 and r.source == "big")
        assert abs(half / read["big"] - 0.5) < 0.1


def test_ranks_are_permutations(spark):
    for n in (1, 2, 8, 64, 512):
        df = spark.range(n).select(mixing._rank(F.col("id"), F.lit(n), F.lit(1), F.lit("s"), F.lit(0)).alias("r"))
        assert sorted(r.r for r in df.collect()) == list(range(n))


def test_permutations_differ_by_epoch_and_are_repeatable(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    a = sorted((r.doc_id, r.mix_epoch, r.mix_key) for r in mixing.mix(docs, 0.99, 8.0).collect())
    assert a == sorted((r.doc_id, r.mix_epoch, r.mix_key) for r in mixing.mix(docs.repartition(7), 0.99, 8.0).collect())
    order = lambda e: [i for _, i in sorted((k, i) for i, x, k in a if x == e)]
    assert order(0)[:50] != order(1)[:50]


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, "a", "", ""), (2, "", "b", "", ""), (None, "x y", None, "", ""), (None, "x y", None, "", ""), (5, "z " * 50_000, "b", "", "")]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {1, 2, None, 5}
    assert all(set(r.asDict()) == {"doc_id", "text", "source", "tokens", "mix_epoch", "mix_key", "mix_weight"} for r in got)
    plain = mixing.mix(spark.createDataFrame(rows, SCHEMA), facts=False)
    assert plain.columns == ["doc_id", "text", "source", "mix_key", "tokens"] and plain.count() == len(got)
    alone = mixing.mix(spark.createDataFrame(rows[-1:], SCHEMA)).collect()
    assert len(alone) == 1 and alone[0].mix_weight == 1


def test_repeated_rows_keep_the_budget(spark):
    """Rows of one key that stand where an epoch stops are read one by one until the budget is met."""
    rows = [(1, "w " * 60, "hot", "", "")] * 200 + [(2, "v " * 50, "hot", "", "")] * 3 + [(10 + i, "w " * 100, "cold", "", "") for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for budget in (6000, 12_000, 20_000):
        plan = {r.source: r for r in mixing.plan(docs.select("source", mixing.n_tokens(F.col("text")).alias("n_tokens")), 0.95, 4.0, budget).collect()}
        read = Counter()
        for r in mixing.mix(docs, 0.95, 4.0, budget).collect():
            read[r.source] += len(r.text.split())
        for s, p in plan.items():
            want = p.epochs * p.tokens
            assert want - 1e-6 <= read[s] <= want + 100, (s, budget, read[s], want)


def chained(*parts):
    """XXH64 of longs, ints (as ("int", x)) and texts, each seeded by the one before, from 42 on; nulls are passed over."""
    seed = 42
    for x in parts:
        if x is None:
            continue
        data = x.encode() if isinstance(x, str) else struct.pack("<i", x[1]) if isinstance(x, tuple) else struct.pack("<q", x)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_rows_read_by_plain_python(spark, monkeypatch):
    """Every row of every epoch, by sorting whole sources; blocks and runs of blocks are small, so all levels are met."""
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "WIDE", 8)
    rows, seed = corpus(), ("int", 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    budget = 9000
    plan = {r.source: r for r in mixing.plan(docs.select("source", mixing.n_tokens(F.col("text")).alias("n_tokens")), 0.95, 4.0, budget).collect()}
    want = {}
    for s, p in plan.items():
        own = [(i, len(t.split()), signed(chained(i, seed))) for i, t, x, *_ in rows if x == s]
        blocks = 2 ** max(0, math.ceil(math.log2(p.n / 4)))
        half = max(1, math.ceil(math.log2(blocks) / 2))
        for epoch in range(math.ceil(p.epochs)):
            draw = [chained(("int", k), seed, s, epoch) & ((1 << 31) - 1) for k in range(1, 5)]
            order = []
            for i, t, h in own:
                x = ((h % blocks) * (draw[0] | 1) + draw[1]) % blocks
                place = ((x ^ (x >> half)) * (draw[2] | 1) + draw[3]) % blocks
                order.append((place, (chained(seed, epoch, h) >> 11) / 2.0**53, i, t))
            left = (p.epochs - epoch) * p.tokens
            for place, spot, i, t in sorted(order):
                if epoch + 1 <= p.epochs or left > 0:
                    want[i, epoch] = min(1.0, (epoch + (place + spot) / blocks) / p.epochs)
                left -= t
    got = {(r.doc_id, r.mix_epoch): r.mix_key for r in mixing.mix(docs, 0.95, 4.0, budget).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
