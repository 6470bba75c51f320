import numpy as np

from panelspark.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, kept string"


def brute(rows, threshold=0.98):
    good = {}
    for i, (v, e, label, *_) in enumerate(rows):
        if v is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(x != 0 for x in e):
            x = np.array(np.array(e, np.float32), np.float64)
            good[i] = x / np.linalg.norm(x)
    comp = {i: rows[i][0] for i in range(len(rows))}
    links = dict.fromkeys(range(len(rows)), 0)
    keys = sorted(good)
    pairs = [(i, j) for i in keys for j in keys if i < j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= threshold - 1e-12]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            low = min(comp[i], comp[j])
            changed |= comp[i] != low or comp[j] != low
            comp[i] = comp[j] = low
    return sorted(((rows[i][0], links[i], comp[i], rows[i][0] is None or comp[i] == rows[i][0]) for i in range(len(rows))), key=str)


def rows_of(spark_rows):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in spark_rows), key=str)


def corpus(seed=0, n=260, width=8):
    rng = np.random.default_rng(seed)
    rows, k = [], 0
    centres = rng.normal(size=(12, width))
    for i in range(n):
        c = centres[i % 12] + rng.normal(size=width) * rng.choice([0.01, 0.08, 0.3])
        rows.append([k, [float(np.float32(x)) for x in c], int(i % 3), "", ""])
        k += 1
        if i % 9 == 0:  # copies and multiples
            rows.append([k, list(rows[-1][1]), rows[-1][2], "", ""])
            rows.append([k + 1, [2 * x for x in rows[-1][1]], rows[-1][2], "", ""])
            k += 2
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    odd = [[900, None, 1, "", ""], [901, [], 1, "", ""], [902, [0.0] * 8, 1, "", ""], [903, [float("nan")] + [1.0] * 7, 1, "", ""], [904, [None] + [1.0] * 7, 1, "", ""], [905, [1.0] * 8, None, "", ""], [None, [1.0] * 8, 1, "", ""], [906, [1.0] * 7, 1, "", ""], [907, [1.0] * 8, 1, "", ""], [908, [float("inf")] + [1.0] * 7, 1, "", ""]]
    rows += odd
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    want = brute(rows)
    assert sum(r[1] for r in want) > 200
    for block in (512, 20):
        assert rows_of(vectors.near_vectors(df, block=block).collect()) == want, block


def test_dense_group_and_repeated_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=5)
    rows = [[i, [float(np.float32(x)) for x in base + rng.normal(size=5) * 0.03], 1, "", ""] for i in range(300)]
    rows += [list(rows[3]), list(rows[3])]
    got = rows_of(vectors.near_vectors(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), block=64).collect())
    assert got == brute(rows)


def test_nothing_usable(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    got = vectors.near_vectors(spark.createDataFrame([(1, None, 1, "", ""), (2, [0.0], 1, "", "")], SCHEMA)).collect()
    assert rows_of(got) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_the_join_skips_and_loses_nothing():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(np.floor(x[:, ::-1].T / 0.2))]
    for same in (True, False):
        y = x if same else x[::2]
        i, j = vectors.ego_join(x[:, :3], y[:, :3], x, y, 0.2, 0.98, same)
        a, b = np.nonzero(x @ y.T >= 0.98)
        keep = a < b if same else slice(None)
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(zip(a[keep].tolist(), b[keep].tolist()))


def test_one_long_vector_among_short_ones(spark):
    """Axes and blocks hold a few numbers for each dimension, never their square."""
    rng = np.random.default_rng(11)
    long = [float(np.float32(x)) for x in rng.normal(size=50_000)]
    rows = corpus(3, 60, 4) + [[1000, long, 1, "", ""], [1001, [2 * x for x in long], 1, "", ""], [1002, [-x for x in long], 1, "", ""]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(spark.createDataFrame([tuple(r) for r in rows], SCHEMA)).collect()}
    assert got[1000] == (1, 1000) and got[1001] == (1, 1000) and got[1002] == (0, 1002)
    short = [r for r in rows if r[0] < 1000]
    assert sorted((i, *v) for i, v in got.items() if i < 1000) == sorted((i, n, c) for i, n, c, _ in brute(short))


def test_axes_are_the_leading_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 20)) * np.array([9, 7, 5, 4, 3, 2.5] + [0.3] * 14)
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vector array<double>")
    mean, axes = vectors.principal(df, 20, 6)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(mean, u.mean(axis=0)) and np.allclose(axes.T @ axes, np.eye(6))
    values, vectors_ = np.linalg.eigh(np.cov(u.T, bias=True))
    caught = np.trace(axes.T @ np.cov(u.T, bias=True) @ axes)
    assert caught > 0.99 * values[-6:].sum()


def test_the_registered_sql(spark, tmp_path):
    """The SQL that the query is compared with, on rows that do link."""
    import duckdb

    from panelspark.llm.queries import ORACLES, QUERIES

    rows = corpus(2, 200) + [[900, None, 1, "", ""], [901, [0.0] * 8, 1, "", ""], [902, [float("nan")] + [1.0] * 7, 1, "", ""], [903, [1.0] * 8, None, "", ""], [904, [1.0] * 7, 1, "", ""]]
    spark.createDataFrame([tuple(r[:3]) for r in rows], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["op4_vectors"]).fetchall())
    assert sum(r[1] for r in want) > 100
    assert sorted(tuple(r) for r in QUERIES["op4_vectors"](spark, str(tmp_path)).select("vec_id", "n_links", "component_id", "kept").collect()) == want
