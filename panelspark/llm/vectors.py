"""Near-duplicate vectors by an epsilon grid order join.

Vectors are scaled to length 1, where a cosine of at least t is a distance of at most sqrt(2 - 2t) = epsilon. They
are sorted by label and by the cells, epsilon wide, of their leading principal dimensions, and the sorted sequence is
cut into blocks. Pairs of sequence intervals are joined recursively from the whole sequence downwards: a pair whose
boxes are further apart than epsilon, or that has no label in common, is skipped with all its parts. The interval
pairs of the upper levels are small tables that are joined by their parents; pairs of blocks that are left are dealt
by tiles of neighbouring blocks, where each block comes once, and tiles go on in the same way on the vectors and
compare what remains in double precision.

Equal vectors of a label form one class first. A pair of blocks gives for each class the number of vectors it
finds linked, and a spanning forest of the links, never all pairs.

Results in odd cases: rows with a null key or label, and vectors that are null, empty, zero or hold null or
non-finite components link with nothing and are kept; vectors of unlike lengths do not link; repeated rows count as
vectors of their own; an empty table gives an empty table; further columns of the input are not carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, tasks
from .components import connected_components

#: Principal dimensions of the grid, vectors of a block, of a directly compared interval, and children of an interval.
DIMS, BLOCK, LEAF, FAN = 6, 512, 64, 16
#: Components that a block, or a batch at work, holds at most (one vector where that is longer).
NUMBERS = 512 * 1024
#: Further directions of the subspace iteration, and its passes.
SPARE, PASSES = 4, 2


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)


def _units(vectors: list) -> np.ndarray:
    """Vectors of one length as rows of length 1 in double precision."""
    out = np.array(vectors, np.float64)
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _by_length(column: pa.Array, numbers: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of a batch, vectors of one length together, about ``numbers`` components at once."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        places, step = np.flatnonzero(sizes == size), max(1, numbers // int(size))
        for at in range(0, len(places), step):
            part = places[at : at + step]
            yield part, _units(column.take(pa.array(part)).to_pylist())


def principal(classes: DataFrame, width: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes of the unit vectors, shorter ones filled up with zeros, by subspace iteration.

    A pass over all vectors multiplies their covariance with a few directions: tasks and driver hold ``width`` times
    ``dims`` + SPARE numbers, never ``width`` squared, and a vector only its own length. The axes are orthonormal
    whatever the number of passes, so distances on them never exceed distances of vectors, which is all that the
    skips rely on.
    """
    k = min(width, dims + SPARE)
    axes = np.linalg.qr(np.random.default_rng(0).standard_normal((width, k)))[0]

    def times(axes: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width, k + 1))
            count = 0
            for batch in batches:
                for part, x in _by_length(batch.column(0), NUMBERS):
                    size = x.shape[1]
                    total[:size, :k] += x.T @ (x @ axes[:size])
                    total[:size, k] += x.sum(axis=0)
                    count += len(part)
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int64()), pa.array([*total.tolist(), [float(count)] * (k + 1)], pa.list_(pa.float64()))], names=["at", "v"])

        sums = classes.select("vector").mapInArrow(run, "at long, v array<double>").groupBy("at").agg(*(F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(k + 1))).orderBy("at").toArrow()
        out = np.column_stack([sums.column(f"v{i}").to_numpy() for i in range(k + 1)])
        n = out[-1, 0]
        mean = out[:-1, k] / n
        return mean, out[:-1, :k] / n - np.outer(mean, mean @ axes)

    for _ in range(PASSES - 1):
        mean, product = times(axes)
        # vectors that are all alike leave no direction; qr fills up with orthonormal ones
        axes = np.linalg.qr(product)[0]
    mean, product = times(axes)
    within = axes.T @ product
    values, turn = np.linalg.eigh((within + within.T) / 2)
    return mean, axes @ turn[:, np.argsort(-values, kind="stable")[:dims]]


def _blocks(size: int):
    """Cuts the sorted rows of a task into blocks of one label and length, each with the box of its grid values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            nonlocal number, held
            rows, held = held, []
            p = np.array([r["grid"] for r in rows])
            number += 1
            cols = {
                "task": [task],
                "number": [number],
                "label": [rows[0]["label"]],
                "size": [len(rows[0]["vector"])],
                "low": [p.min(axis=0).tolist()],
                "high": [p.max(axis=0).tolist()],
                "reps": [np.array([r["rep"] for r in rows], np.int64).tobytes()],
                "counts": [np.array([r["n"] for r in rows], np.int64).tobytes()],
                "grids": [p.tobytes()],
                "vectors": [np.array([r["vector"] for r in rows], np.float64).tobytes()],
            }
            return pa.RecordBatch.from_pydict(cols, schema=schema)

        schema = None
        for batch in batches:
            if schema is None:
                label = batch.schema.field("label").type
                schema = pa.schema([("task", pa.int64()), ("number", pa.int64()), ("label", label), ("size", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("reps", pa.binary()), ("counts", pa.binary()), ("grids", pa.binary()), ("vectors", pa.binary())])
            for at in range(0, batch.num_rows, size):
                for r in batch.slice(at, size).to_pylist():
                    if held and (len(held) == min(size, max(1, NUMBERS // len(r["vector"]))) or held[0]["label"] != r["label"] or len(held[0]["vector"]) != len(r["vector"])):
                        yield block()
                    held.append(r)
        if held:
            yield block()

    return run


def _apart(a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(b_low - a_high, a_low - b_high))
    return float(gap @ gap)


def ego_join(p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray, epsilon: float, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two sorted sequences with grid values p, q and unit vectors x, y whose cosine reaches the
    threshold; with ``same``, each pair of one sequence once."""
    found_a, found_b = [], []
    limit = (epsilon + 1e-9) ** 2

    def go(a0: int, a1: int, b0: int, b1: int) -> None:
        if same and b1 <= a0 + 1 and b1 - b0 <= LEAF:
            return
        if _apart(p[a0:a1].min(axis=0), p[a0:a1].max(axis=0), q[b0:b1].min(axis=0), q[b0:b1].max(axis=0)) > limit:
            return
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            i, j = np.nonzero(x[a0:a1] @ y[b0:b1].T >= threshold)
            i, j = i + a0, j + b0
            if same:
                i, j = i[i < j], j[i < j]
            found_a.append(i)
            found_b.append(j)
            return
        halves = lambda s, e: ((s, (s + e) // 2), ((s + e) // 2, e)) if e - s > LEAF else ((s, e),)
        for a in halves(a0, a1):
            for b in halves(b0, b1):
                if not (same and b[1] <= a[0]):
                    go(*a, *b)

    go(0, len(x), 0, len(y))
    none = np.empty(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what (i, j) connect, fewer than n."""
    if len(i) < n:
        return i, j
    near = np.zeros((n, n), bool)
    near[i, j] = near[j, i] = True
    rest, a, b = np.ones(n, bool), [], []
    for start in range(n):
        if not rest[start]:
            continue
        rest[start], front = False, [start]
        while front:
            at = front.pop()
            new = np.flatnonzero(near[at] & rest)
            rest[new] = False
            a.append(np.full(len(new), at))
            b.append(new)
            front += new.tolist()
    return np.concatenate(a), np.concatenate(b)


def _join_tile(epsilon: float, threshold: float):
    """Joins the pairs of blocks of one tile; each block comes once, with the blocks that it is compared with."""

    def run(table: pa.Table) -> pa.Table:
        blocks = {}
        for r in table.select(["place", "size", "reps", "counts", "grids", "vectors"]).to_pylist():
            v = np.frombuffer(r["vectors"], np.float64).reshape(-1, r["size"])
            blocks[r["place"]] = np.frombuffer(r["grids"], np.float64).reshape(-1, DIMS), _units(v), np.frombuffer(r["reps"], np.int64), np.frombuffer(r["counts"], np.int64)
        out: list[tuple[np.ndarray, ...]] = []
        for a, others in zip(table.column("place").to_pylist(), table.column("others").to_pylist(), strict=True):
            p, x, rep_a, n_a = blocks[a]
            for b in sorted(others):
                same = a == b
                q, y, rep_b, n_b = blocks[b]
                if x.shape[1] != y.shape[1]:
                    continue
                i, j = ego_join(p, q, x, y, epsilon, threshold, same)
                if not len(i):
                    continue
                reps, at = (rep_a, 0) if same else (np.concatenate([rep_a, rep_b]), len(rep_a))
                j = j + at
                links = np.bincount(i, n_b[j - at], len(reps)) + np.bincount(j, n_a[i], len(reps))
                some = np.flatnonzero(links)
                i, j = _forest(i, j, len(reps))
                out.append((np.concatenate([reps[some], reps[i]]), np.concatenate([np.full(len(some), -1), reps[j]]), np.concatenate([links[some].astype(np.int64), np.zeros(len(i), np.int64)])))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 3
        return pa.table({"a": cols[0], "b": cols[1], "links": cols[2], "is_link": cols[2] == 0})

    return run


def block_pairs(blocks: DataFrame, n: int, epsilon: float) -> DataFrame:
    """(a, b) of the blocks, a <= b by ``place``, that the recursive join of intervals does not skip.

    ``blocks`` holds place (0 to n - 1 in sorted order), label, size, low and high. Intervals of FAN neighbours make
    the next level, up to one that holds all. From there pairs are replaced by the pairs of their children, level by
    level, by equality joins on the parents.
    """
    levels = [blocks.select("place", F.col("label").alias("from_label"), F.col("label").alias("to_label"), "low", "high")]
    while n > 1:
        n = -(-n // FAN)
        box = lambda c, f: F.array(*(f(F.get(c, F.lit(k))) for k in range(DIMS)))
        levels.append(checkpoint(levels[-1].groupBy(F.floor(F.col("place") / FAN).alias("place")).agg(F.min("from_label").alias("from_label"), F.max("to_label").alias("to_label"), box("low", F.min).alias("low"), box("high", F.max).alias("high"))))
    pairs = levels[-1].select(F.col("place").alias("a"), F.col("place").alias("b"))
    for level in reversed(levels[:-1]):
        side = lambda s, level=level: level.select(F.floor(F.col("place") / FAN).alias(f"{s}_parent"), *(F.col(c).alias(f"{s}_{c}") for c in level.columns))
        met = pairs.join(side("a"), F.col("a") == F.col("a_parent")).join(side("b"), F.col("b") == F.col("b_parent"))
        gap = lambda k: F.greatest(F.lit(0.0), F.get("b_low", F.lit(k)) - F.get("a_high", F.lit(k)), F.get("a_low", F.lit(k)) - F.get("b_high", F.lit(k)))
        apart = sum((gap(k) * gap(k) for k in range(1, DIMS)), gap(0) * gap(0))
        near = (F.col("a_place") <= F.col("b_place")) & (F.col("a_from_label") <= F.col("b_to_label")) & (F.col("b_from_label") <= F.col("a_to_label")) & (F.coalesce(apart, F.lit(0.0)) <= (epsilon + 1e-9) ** 2)
        pairs = met.where(near).select(F.col("a_place").alias("a"), F.col("b_place").alias("b"))
    return pairs


def near_vectors(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label)."""
    rows = vectors.select("vec_id", F.col("label").alias("group"), F.when(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.col("embedding")).alias("vector"))
    classes = checkpoint(rows.where(F.col("vector").isNotNull()).groupBy(F.col("group").alias("label"), "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    width, number = classes.agg(F.max(F.size("vector")), F.count("*")).first()
    if width is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    epsilon = float(np.sqrt(max(2 - 2 * threshold, 0.0)))
    mean, axes = principal(classes, width, DIMS)

    centre = mean @ axes

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.zeros((batch.num_rows, DIMS))
            for part, x in _by_length(batch.column(1), NUMBERS):
                grid[part, : axes.shape[1]] = x @ axes[: x.shape[1]] - centre
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(grid.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "grid"])

    placed = classes.mapInArrow(project, f"label {classes.schema['label'].dataType.simpleString()}, vector {classes.schema['vector'].dataType.simpleString()}, rep long, n long, grid array<double>")
    cells = [F.floor(F.get("grid", F.lit(k)) / F.lit(max(epsilon, 1e-6))) for k in range(DIMS)]
    # a task sorts and cuts some hundred thousand vectors, and compares some hundred pairs of blocks
    width_out = tasks(vectors.sparkSession, number, 400_000, 4 * block)
    order = ["label", F.size("vector"), *cells, "rep"]
    kind = classes.schema["label"].dataType.simpleString()
    made = placed.repartitionByRange(width_out, *order).sortWithinPartitions(*order).mapInArrow(_blocks(block), f"task long, number long, label {kind}, size long, low array<double>, high array<double>, reps binary, counts binary, grids binary, vectors binary")
    made = checkpoint(made)
    # tasks are in sorted order; their block counts, one number a task, place the blocks in one sequence
    counts = sorted((r["task"], r["n"]) for r in made.groupBy("task").agg(F.count("*").alias("n")).collect())
    starts, n = [], 0
    for task, m in counts:
        starts.append((task, n))
        n += m
    first = vectors.sparkSession.createDataFrame(starts, "first_task long, start long")
    blocks = made.join(F.broadcast(first), F.col("task") == F.col("first_task")).withColumn("place", F.col("start") + F.col("number") - 1).drop("first_task", "start", "task", "number")
    pairs = checkpoint(block_pairs(blocks, n, epsilon))
    # pairs of blocks are joined by tiles of FAN x FAN, so that a block travels once a tile
    tile = [F.floor(F.col(c) / FAN).alias(f"tile_{c}") for c in "ab"]
    met = pairs.select(*tile, "a", "b")
    sides = met.select("tile_a", "tile_b", F.col("a").alias("place"), "b").unionByName(met.select("tile_a", "tile_b", F.col("b").alias("place"), F.lit(None).cast("long").alias("b")))
    members = sides.groupBy("tile_a", "tile_b", "place").agg(F.collect_list("b").alias("others")).withColumnRenamed("place", "at")
    sent = members.join(blocks.select("place", "size", "reps", "counts", "grids", "vectors"), F.col("at") == F.col("place")).drop("at")
    found = checkpoint(sent.groupBy("tile_a", "tile_b").applyInArrow(_join_tile(epsilon, threshold), "a long, b long, links long, is_link boolean"))
    parts = connected_components(found.where("is_link").select("a", "b"))
    links = found.where("not is_link").groupBy(F.col("a").alias("link_rep")).agg(F.sum("links").alias("links"))
    named = classes.join(links, F.col("rep") == F.col("link_rep"), "left").join(parts, F.col("rep") == F.col("node"), "left").select(F.col("label").alias("c_label"), F.col("vector").alias("c_vector"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    lone = rows.where(F.col("vector").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = rows.where(F.col("vector").isNotNull()).join(named, (F.col("group") == F.col("c_label")) & (F.col("vector") == F.col("c_vector")))
    out = joined.select("vec_id", "n_links", "component_id").unionByName(lone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
