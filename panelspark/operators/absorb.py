"""Projection on group effects from sums by group, never from rows.

Columns c are projected on effects, each with groups and a multiplier s (1 for levels, a slope otherwise). All that is
needed are sums of w*s*s' and w*s*c by cell, a cell being a combination of all groups:

- one set of keys: each group is solved on its own, in closed form, by column expressions over the table of groups;
- several sets of keys, cells up to CELLS: the cells come to the driver, where conjugate gradients, preconditioned by
  the exact solution of each group's block, solve for all columns side by side;
- more cells, or wider ones: the same iteration with the same preconditioner over tables of groups, one join and one
  aggregate of the cells for each effect. Of two sets of keys the one with more groups is eliminated exactly, which
  halves the steps, and the cells stay dealt by either set.

The solution is one table of groups and coefficients for each set of keys.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint
from . import blocks
from .moments import cross, pairs, square
from .sample import prune

#: So many cells, by an estimate within a few hundredths, come to the driver at most (a few numbers each).
CELLS = 3_000_000
#: So many numbers of all cells together: wide models bring fewer cells (half of Spark's default limit on results).
NUMBERS = 60_000_000
#: So many groups of a single set of keys come to the driver at most.
GROUPS = 200_000
#: So many groups are broadcast at most when their coefficients meet the rows.
BROADCAST = 200_000


@dataclass
class Level:
    """The solution for one set of keys: a table of the keys with t{e}_{c}, effect e's coefficient for column c."""

    keys: list[str]
    effects: list[int]
    table: DataFrame
    groups: int


@dataclass
class Projection:
    levels: list[Level]
    within: np.ndarray
    n: int
    weight: float
    iterations: list[int]
    converged: bool
    groups: list[int]
    dropped: int
    extra: tuple = field(default=())
    #: sums of products before projection
    total: np.ndarray | None = None
    #: where there is one set of keys: the matrix of sums over groups of a's by group, for a list of pairs (u, v) of
    #: linear combinations of columns, a = sum within the group of w * (residual of u) * (residual of v)
    by_group: Callable[[list[tuple[dict[int, float], dict[int, float]]]], np.ndarray] | None = None


def _inner(rows: DataFrame, table: DataFrame, keys: list[str], groups: int, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(table) if groups <= BROADCAST else table, keys, how)


def residual_columns(rows: DataFrame, levels: list[Level], columns: list[str], multipliers: list[Column], combos: list[dict[int, float]]) -> tuple[DataFrame, list[Column]]:
    """The rows of the sample joined with their groups' coefficients, and for each linear combination of columns
    (column number -> factor) its projection residual."""
    out = rows
    for level in levels:
        fitted = [(F.lit(0.0) + sum(f * F.col(f"t{e}_{c}") for c, f in combo.items())).alias(f"f{e}_{k}") for e in level.effects for k, combo in enumerate(combos)]
        out = _inner(out, level.table.select(*level.keys, *fitted), level.keys, level.groups)
    exprs = []
    for k, combo in enumerate(combos):
        x = sum((f * F.col(columns[c]) for c, f in combo.items()), F.lit(0.0))
        for level in levels:
            for e in level.effects:
                x = x - multipliers[e] * F.col(f"f{e}_{k}")
        exprs.append(x)
    return out, exprs


def project(rows: DataFrame, columns: list[str], weight: Column | None, effects: list[tuple[tuple[str, ...], Column | None]], tol: float, maxiter: int, drop: bool, rule: str, flags: list[Column]) -> Projection:
    """Sums of products of the columns within the effects, and the effects' coefficients for each column.

    ``effects`` are (keys, multiplier). ``flags`` are further aggregates over all rows.
    """
    keys: list[tuple[str, ...]] = list(dict.fromkeys(tuple(sorted(k)) for k, _ in effects))
    slopes = sum(s is not None for _, s in effects)
    simple = len(keys) == 1 and len(effects) - slopes <= 1 and slopes <= 1
    return (_one_key if simple else _many_keys)(rows, columns, weight, effects, keys, tol, maxiter, drop, rule, flags)


# ---- one set of keys ------------------------------------------------------------------------------------------


def _one_key(rows, columns, weight, effects, keys, tol, maxiter, drop, rule, flags) -> Projection:
    key, p = list(keys[0]), len(columns)
    w = weight if weight is not None else F.lit(1.0)
    level = next((i for i, (_, s) in enumerate(effects) if s is None), None)
    slope = next((i for i, (_, s) in enumerate(effects) if s is not None), None)
    v = effects[slope][1] if slope is not None else None
    sums = [F.count("*").alias("n"), F.sum(w).alias("w")]
    sums += [F.sum(w * F.col(c)).alias(f"s_{k}") for k, c in enumerate(columns)]
    if v is not None:
        sums += [F.sum(w * v).alias("sv"), F.sum(w * v * v).alias("svv"), *(F.sum(w * v * F.col(c)).alias(f"v_{k}") for k, c in enumerate(columns))]
    narrow = len(pairs(p)) <= 21
    if narrow:
        sums += [F.sum(w * F.col(columns[i]) * F.col(columns[j])).alias(f"q_{i}_{j}") for i, j in pairs(p)]
    sums += [f.alias(f"flag_{k}") for k, f in enumerate(flags)]
    table = rows.groupBy(*key).agg(*sums).persist()
    try:
        if table.count() <= GROUPS:
            arrow = table.toArrow()
            total = None if narrow else lambda kept, groups: cross(_inner(rows, kept, key, groups, "left_semi"), [F.col(c) for c in columns], weight)[0]
            return _one_key_on_driver(rows.sparkSession, arrow, key, effects, p, level, slope, drop, len(flags), total)
        table, cached = checkpoint(table), table
    finally:
        table.unpersist()
    cached.unpersist()
    kept = table.where("n > 1") if drop else table
    # coefficients of each group, and the columns' components along its orthogonal directions
    parts, thetas = [], []
    if v is not None and level is not None:
        mean = F.col("sv") / F.col("w")
        spread = F.col("svv") - F.col("sv") * mean
        for k in range(p):
            own = F.col(f"v_{k}") - mean * F.col(f"s_{k}")
            b = F.when(spread > F.col("svv") * 1e-13, own / spread).otherwise(0.0)
            thetas += [b.alias(f"t{slope}_{k}"), (F.col(f"s_{k}") / F.col("w") - b * mean).alias(f"t{level}_{k}")]
        parts.append([F.when(spread > F.col("svv") * 1e-13, (F.col(f"v_{k}") - mean * F.col(f"s_{k}")) / F.sqrt(spread)).otherwise(0.0) for k in range(p)])
    elif v is not None:
        thetas += [F.when(F.col("svv") > 0, F.col(f"v_{k}") / F.col("svv")).otherwise(0.0).alias(f"t{slope}_{k}") for k in range(p)]
        parts.append([F.when(F.col("svv") > 0, F.col(f"v_{k}") / F.sqrt("svv")).otherwise(0.0) for k in range(p)])
    if level is not None:
        if v is None:
            thetas += [(F.col(f"s_{k}") / F.col("w")).alias(f"t{level}_{k}") for k in range(p)]
        parts.append([F.col(f"s_{k}") / F.sqrt("w") for k in range(p)])
    q = [F.sum(f"q_{i}_{j}") for i, j in pairs(p)] if narrow else []
    facts = [F.sum("n"), F.sum("w"), F.count("*")]
    checks = table.agg(*(F.max(f"flag_{k}") for k in range(len(flags))), F.sum("n")).first() if flags else (None,)
    explained, got = cross(kept, parts[0], extra=[*facts, *q])
    for more in parts[1:]:
        explained = explained + cross(kept, more)[0]
    n, weight_sum, groups = got[0] or 0, got[1] or 0.0, got[2]
    if narrow:
        total = square([x or 0.0 for x in got[3:]], p)
    else:
        total = cross(_inner(rows, kept.select(*key), key, groups, "left_semi"), [F.col(c) for c in columns], weight)[0]
    solved = Level(key, [i for i in range(len(effects))], kept.select(*key, *thetas), groups)

    def by_group(products):
        inner = lambda i, j: F.col(f"q_{min(i, j)}_{max(i, j)}") - sum((x[i] * x[j] for x in parts), F.lit(0.0))
        sums_ = [sum((float(a * b) * inner(i, j) for i, a in u.items() for j, b in v.items()), F.lit(0.0)) for u, v in products]
        return cross(kept, sums_)[0]

    return Projection([solved], total - explained, int(n), float(weight_sum), [1] * p, True, [groups] * len(effects), int((checks[-1] or 0) - n) if flags else 0, tuple(checks[:-1]), total, by_group if narrow else None)


def _one_key_on_driver(spark, arrow, key, effects, p, level, slope, drop, n_flags, total) -> Projection:
    """The same closed form in numpy, for a table of groups that is small."""
    import pyarrow as pa
    import pyarrow.compute

    raised = tuple(bool(arrow.num_rows) and pa.compute.any(arrow.column(f"flag_{k}")).as_py() for k in range(n_flags))
    before = int(arrow.column("n").to_numpy().sum()) if arrow.num_rows else 0
    if drop:
        arrow = arrow.filter(pa.compute.greater(arrow.column("n"), 1))
    num = lambda c: arrow.column(c).to_numpy().astype(float)
    block = lambda name: np.column_stack([num(f"{name}_{k}") for k in range(p)])
    w, s = num("w"), block("s")
    explained, theta, axes = np.zeros((p, p)), {}, []
    ratio = lambda a, b, ok: np.divide(a, b[:, None], out=np.zeros_like(a), where=ok[:, None])
    if slope is not None:
        v, sv, svv = block("v"), num("sv"), num("svv")
        if level is not None:
            v, spread = v - (sv / w)[:, None] * s, svv - sv * sv / w
        else:
            spread = svv
        some = spread > svv * 1e-13
        theta[slope] = ratio(v, spread, some)
        axes.append((theta[slope], np.where(some[:, None], v, 0)))
    if level is not None:
        theta[level] = s / w[:, None]
        axes.append((theta[level], s))
    for t, v in axes:
        explained += t.T @ v
    if level is not None:
        if slope is not None:
            theta[level] = theta[level] - theta[slope] * (sv / w)[:, None]
    fields = {k: arrow.column(k) for k in key} | {f"t{e}_{k}": t[:, k] for e, t in theta.items() for k in range(p)}
    made = spark.createDataFrame(pa.table(fields)) if len(w) else spark.createDataFrame([], ", ".join([*(f"{k} string" for k in key), *(f"t{e}_{k} double" for e in theta for k in range(p))]))
    groups, n = len(w), int(num("n").sum())
    gram = total(made.select(*key), groups) if total else square([num(f"q_{i}_{j}").sum() for i, j in pairs(p)], p)

    def by_group(products):
        inner = lambda i, j: num(f"q_{min(i, j)}_{max(i, j)}") - sum(t[:, i] * v[:, j] for t, v in axes)
        known: dict = {}
        out = np.zeros((groups, len(products)))
        for k, (u, v) in enumerate(products):
            for i, a in u.items():
                for j, b in v.items():
                    if (i, j) not in known:
                        known[i, j] = inner(i, j)
                    out[:, k] += a * b * known[i, j]
        return out.T @ out

    within = gram - (explained + explained.T) / 2
    return Projection([Level(key, list(range(len(effects))), made, groups)], within, n, float(w.sum()), [1] * p, True, [groups] * len(effects), before - n, raised, gram, None if total else by_group)


# ---- several sets of keys -------------------------------------------------------------------------------------


@dataclass
class _Names:
    """Names of the sums by cell. Effects without a slope share theirs, and the constant (the last column) repeats the
    sums of weights."""

    multipliers: list[str]
    last: int
    weighted: bool

    def m(self, a: int, b: int) -> str:
        x, y = sorted((self.multipliers[a], self.multipliers[b]))
        return self.total if x == y == "1" else f"m_{x}_{y}"

    def b(self, a: int, c: int) -> str:
        s = self.multipliers[a]
        if c == self.last:
            return self.total if s == "1" else f"m_1_{s}"
        return f"c_{c}" if s == "1" else f"b_{s}_{c}"

    @property
    def total(self) -> str:
        return "w" if self.weighted else "n"


def _many_keys(rows, columns, weight, effects, keys, tol, maxiter, drop, rule, flags) -> Projection:
    p, e = len(columns), len(effects)
    w = weight if weight is not None else F.lit(1.0)
    every = list(dict.fromkeys(k for ks in keys for k in ks))
    s = [x if x is not None else F.lit(1.0) for _, x in effects]
    names = _Names([f"v{k}" if x is not None else "1" for k, (_, x) in enumerate(effects)], p - 1, weight is not None)
    sums = {f"c_{k}": w * F.col(c) for k, c in enumerate(columns[:-1])}
    sums |= {names.b(a, k): w * s[a] * F.col(c) for a in range(e) for k, c in enumerate(columns)}
    sums |= {names.m(a, b): w * s[a] * s[b] for a, b in combinations_with_replacement(range(e), 2)}
    sums[names.total] = w
    # a constant times the number of rows is that number
    sums.pop("n", None)
    cells = rows.groupBy(*every).agg(F.count("*").cast("double").alias("n"), *(F.sum(x).alias(n) for n, x in sums.items()))
    # the pass that sums products also estimates the number of cells
    total, got = cross(rows, [F.col(c) for c in columns], weight, [F.count("*"), F.approx_count_distinct(F.xxhash64(*every)), *flags])
    got, size = (got[0], *got[2:]), got[1]
    if size <= CELLS and size * (len(sums) + len(every) + 1) <= NUMBERS:
        return _on_driver(rows.sparkSession, cells.toArrow(), columns, keys, effects, names, total, got, tol, maxiter, drop, rule)
    if len(keys) == 2 and len(columns) > 1 and blocks.whole(rows, every):
        # cells that are hardly fewer than rows are summed where they are dealt to
        plain = rows.select(*every, F.lit(1.0).alias("n"), *(x.alias(n) for n, x in sums.items()))
        if found := _by_blocks(rows, columns, cells if 2 * size < got[0] else plain, size, keys, effects, names, total, got, tol, maxiter, drop, rule):
            return found
    return _by_tables(rows, columns, weight, checkpoint(cells), keys, effects, names, total, got, tol, maxiter, drop, rule)


def _codes(arrow, columns: list[str]) -> tuple[np.ndarray, list]:
    """Dense codes of the combinations of some columns, and the combinations themselves as Arrow arrays."""
    import pyarrow as pa
    import pyarrow.compute

    code = np.zeros(arrow.num_rows, np.int64)
    for c in columns:
        d = arrow.column(c).combine_chunks().dictionary_encode()
        code = code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False)
        _, code = np.unique(code, return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, [arrow.column(c).combine_chunks().take(pa.array(first)) for c in columns]


def _on_driver(spark, arrow, columns, keys, effects, names, total, got, tol, maxiter, drop, rule) -> Projection:
    import pyarrow as pa

    p, e, last = len(columns), len(effects), len(columns) - 1
    num = lambda c: arrow.column(c).to_numpy()
    n = num("n")
    by_key = {k: _codes(arrow, list(k)) for k in keys}
    code = [by_key[tuple(sorted(k))][0] for k, _ in effects]
    keep = prune([by_key[k][0] for k in keys], n, rule) if drop else np.ones(len(n), bool)
    if not keep.all():
        # a row that is alone in a group is alone in its cell, whose sums are then the row itself
        lost = np.column_stack([*(num(f"c_{k}") for k in range(last)), num(names.total)])[~keep]
        total = total - lost.T @ (lost / num(names.total)[~keep][:, None])
    used = {c: num(c) if keep.all() else num(c)[keep] for c in arrow.column_names if c not in {k for ks in keys for k in ks}}
    groups = [int(c.max(initial=-1)) + 1 for c in code]
    code = code if keep.all() else [c[keep] for c in code]
    counts = {k: int((np.bincount(code[next(a for a in range(e) if tuple(sorted(effects[a][0])) == k)]) > 0).sum()) for k in keys}
    # absorbed levels explain the constant in full; it needs no solution
    level = next((a for a, x in enumerate(names.multipliers) if x == "1"), None)
    solved = range(p if level is None else last)
    right = [np.column_stack([np.bincount(code[a], used[names.b(a, k)], groups[a]) for k in solved]) for a in range(e)]
    moments = {(a, b): used[names.m(a, b)] for a in range(e) for b in range(e)}
    theta, iterations, converged = conjugate_gradients(code, groups, moments, right, [tuple(sorted(k)) for k, _ in effects], tol, maxiter)
    explained = sum(t.T @ r for t, r in zip(theta, right, strict=True))
    within = np.zeros((p, p))
    within[: len(solved), : len(solved)] = total[: len(solved), : len(solved)] - (explained + explained.T) / 2
    if level is not None:
        theta = [np.column_stack([t, np.full(len(t), float(a == level))]) for a, t in enumerate(theta)]
        iterations = [*iterations, 1]
    levels = []
    for k in keys:
        own = [a for a in range(e) if tuple(sorted(effects[a][0])) == k]
        there = np.flatnonzero(np.bincount(code[own[0]], minlength=groups[own[0]]))
        arrays = [x.take(pa.array(there)) for x in by_key[k][1]]
        fields = {c: x for c, x in zip(k, arrays, strict=True)} | {f"t{a}_{c}": theta[a][there, c] for a in own for c in range(p)}
        levels.append(Level(list(k), own, spark.createDataFrame(pa.table(fields)), len(there)))
    return Projection(levels, within, int(used["n"].sum()), float(used[names.total].sum()), iterations, converged, [counts[tuple(sorted(k))] for k, _ in effects], int(n[~keep].sum()), tuple(got[1:]), total)


def conjugate_gradients(code, groups, moment, right, keys, tol, maxiter):
    """Solves the effects' normal equations for all right sides at once.

    Preconditioned by the blocks of effects that share keys, solved exactly group by group. Stops for a column when
    its residual, measured in the preconditioner, has shrunk by tol / 10,000.
    """
    e, p = len(code), right[0].shape[1]
    sets: dict[tuple, list[int]] = {}
    for a, k in enumerate(keys):
        sets.setdefault(k, []).append(a)
    blocks = []
    for own in sets.values():
        size = groups[own[0]]
        block = np.zeros((size, len(own), len(own)))
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                block[:, i, j] = np.bincount(code[a], moment[a, b], size)
        scale = np.sqrt(np.maximum(np.einsum("gii->gi", block), 1e-300))
        scaled = block / scale[:, :, None] / scale[:, None, :]
        # directions that a group does not have are left out
        blocks.append((own, np.linalg.pinv(scaled, rcond=1e-11, hermitian=True) / scale[:, :, None] / scale[:, None, :]))

    def precondition(r):
        z = [None] * e
        for own, inv in blocks:
            x = np.einsum("gij,gjp->gip", inv, np.stack([r[a] for a in own], axis=1))
            for i, a in enumerate(own):
                z[a] = x[:, i]
        return z

    alike = all(m is moment[0, 0] for m in moment.values())

    def apply(x):
        columns = []
        for k in range(p):
            # contiguous columns: gathers and sums by group run over them at memory speed
            parts = [x[b][:, k].copy()[code[b]] for b in range(e)]
            if alike:
                t = parts[0]
                for part in parts[1:]:
                    t += part
                t *= moment[0, 0]
            columns.append([np.bincount(code[a], t if alike else sum(moment[a, b] * parts[b] for b in range(e)), groups[a]) for a in range(e)])
        return [np.column_stack([c[a] for c in columns]) for a in range(e)]

    dot = lambda u, v: sum((a * b).sum(axis=0) for a, b in zip(u, v, strict=True))
    theta = [np.zeros_like(r) for r in right]
    r = [x.copy() for x in right]
    z = precondition(r)
    d = [x.copy() for x in z]
    rz = dot(r, z)
    goal = rz * (min(tol, 1e-6) * 1e-4) ** 2
    iterations, open_ = np.zeros(p, int), rz > 0
    while open_.any() and iterations.max(initial=0) < maxiter:
        q = apply(d)
        dq = dot(d, q)
        step = np.where(open_ & (dq > 0), rz / np.where(dq > 0, dq, 1), 0.0)
        for a in range(e):
            theta[a] += step * d[a]
            r[a] -= step * q[a]
        z = precondition(r)
        new = dot(r, z)
        iterations += open_
        open_ = open_ & (new > goal) & (dq > 0)
        ratio = np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0)
        for a in range(e):
            d[a] = z[a] + ratio * d[a]
        rz = new
        if sum(len(s) for s in sets.values()) and len(sets) == 1:
            open_[:] = False  # the preconditioner is the inverse
    return theta, np.maximum(iterations, 1).tolist(), not open_.any()


# ---- packed blocks, for cells of two sets of whole-number keys that stay on the executors ------------------------


def _by_blocks(rows, columns, cells, size, keys, effects, names, total, got, tol, maxiter, drop, rule) -> Projection | None:
    """None where a group has so many rows that they should not meet in one task."""
    p, e, before = len(columns), len(effects), got[0]
    base = blocks.groups_of(rows, keys)
    try:
        about = {k: t.agg(F.count("*"), F.max("n")).first() for k, t in base.items()}
        if max(x[1] or 0 for x in about.values()) * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) > max(4 * before, 1_000_000):
            return None
        gone, dropped = blocks.peel(base, rule, BROADCAST) if drop else (None, 0)
    finally:
        for table in base.values():
            table.unpersist()
    del base, table
    blocks.tidy(rows.sparkSession)
    own = {k: [a for a in range(e) if tuple(sorted(effects[a][0])) == k] for k in keys}
    level = next((a for a, x in enumerate(names.multipliers) if x == "1"), None)
    solved = range(p if level is None else p - 1)
    one, two = sorted(keys, key=lambda k: -about[k][0])
    found, explained, lost, n, weight, iterations, converged = blocks.solve(cells, gone, one, two, own, names, p, solved, size, tol, maxiter)
    total = total - lost
    within = np.zeros((p, p))
    within[: len(solved), : len(solved)] = total[: len(solved), : len(solved)] - (explained + explained.T) / 2
    rest = lambda a: [] if level is None else [F.lit(float(a == level)).alias(f"t{a}_{p - 1}")]
    levels = [Level(list(k), own[k], found[k][0].select(*k, *(x for a in own[k] for x in (*(F.col(f"x{a}_{c}").alias(f"t{a}_{c}") for c in solved), *rest(a)))), found[k][1]) for k in keys]
    counts = [*np.maximum(iterations, 1).tolist(), *([] if level is None else [1])]
    return Projection(levels, within, int(n), float(weight), counts, converged, [found[tuple(sorted(k))][1] for k, _ in effects], int(dropped), tuple(got[1:]), total)


# ---- tables of groups, for cells that stay on the executors ---------------------------------------------------


def _by_tables(rows, columns, weight, cells, keys, effects, names, total, got, tol, maxiter, drop, rule) -> Projection:
    p, e = len(columns), len(effects)
    before = got[0]
    if drop:
        cells = _prune_tables(cells, keys, rule)
    own = {k: [a for a in range(e) if tuple(sorted(effects[a][0])) == k] for k in keys}
    m = lambda a, b: F.col(names.m(a, b))
    # absorbed levels explain the constant in full; it needs no solution
    level = next((a for a, x in enumerate(names.multipliers) if x == "1"), None)
    solved = range(p if level is None else p - 1)
    state = {}
    for k in keys:
        sums = [F.sum(m(a, b)).alias(f"m{a}_{b}") for a in own[k] for b in own[k] if b <= a] + [F.sum(names.b(a, c)).alias(f"r{a}_{c}") for a in own[k] for c in solved]
        state[k] = checkpoint(_factors(cells.groupBy(*k).agg(*sums), own[k]).drop(*(f"m{a}_{b}" for a in own[k] for b in own[k] if b <= a)))
    sizes = {k: t.count() for k, t in state.items()}
    if len(keys) == 2 and len(solved):
        state, iterations, converged = _two_sets(cells, keys, own, state, sizes, names, solved, tol, maxiter)
    else:
        state, iterations, converged = _any_sets(cells, keys, own, state, sizes, names, solved, tol, maxiter)
    explained, n_solved = np.zeros((len(solved), len(solved))), len(solved)
    for k in keys if n_solved else []:
        got_k = state[k].agg(*(F.sum(sum((F.col(f"x{a}_{i}") * F.col(f"b{a}_{j}") for a in own[k]), F.lit(0.0))) for i in solved for j in solved)).first()
        explained += np.array(got_k, float).reshape(n_solved, n_solved)
    rest = lambda a: [] if level is None else [F.lit(float(a == level)).alias(f"t{a}_{p - 1}")]
    levels = [Level(list(k), own[k], checkpoint(state[k].select(*k, *(x for a in own[k] for x in (*(F.col(f"x{a}_{c}").alias(f"t{a}_{c}") for c in solved), *rest(a))))), sizes[k]) for k in keys]
    n, wsum = cells.agg(F.sum("n"), F.sum(names.total)).first()
    if n != before:
        lost = rows
        for lv in levels:
            lost = _inner(lost, lv.table.select(*lv.keys), lv.keys, lv.groups, "left_semi")
        total = cross(lost, [F.col(c) for c in columns], weight)[0]
    within = np.zeros((p, p))
    within[:n_solved, :n_solved] = total[:n_solved, :n_solved] - (explained + explained.T) / 2
    counts = [*np.maximum(iterations, 1).tolist(), *([] if level is None else [1])]
    return Projection(levels, within, int(n or 0), float(wsum or 0), counts, converged, [sizes[tuple(sorted(k))] for k, _ in effects], int(before - (n or 0)), tuple(got[1:]), total)


def _any_sets(cells, keys, own, state, sizes, names, solved, tol, maxiter) -> tuple[dict, np.ndarray, bool]:
    """The solution x{a}_{c} of all groups beside their right sides b{a}_{c}, the iterations and whether all converged."""
    e = sum(map(len, own.values()))
    m = lambda a, b: F.col(names.m(a, b))
    parts = lambda k: [*(f"d{a}" for a in own[k]), *(f"l{a}_{b}" for a in own[k] for b in own[k] if b < a)]
    for k in keys:
        solution = lambda c, k=k: _solved({a: F.col(f"r{a}_{c}") for a in own[k]})
        state[k] = state[k].select("*", *(x for c in solved for a, z in solution(c).items() for x in (F.lit(0.0).alias(f"x{a}_{c}"), z.alias(f"p{a}_{c}"), F.col(f"r{a}_{c}").alias(f"b{a}_{c}"))))

    def summed(expr) -> np.ndarray:
        total_ = np.zeros(len(solved))
        for k in keys if len(solved) else []:
            total_ += np.array(state[k].agg(*(F.coalesce(F.sum(expr(k, c)), F.lit(0.0)) for c in solved)).first(), float)
        return total_

    def energy(k, c):
        r = {a: F.col(f"r{a}_{c}") for a in own[k]}
        return sum((r[a] * z for a, z in _solved(r).items()), F.lit(0.0))

    rz = summed(energy)
    goal, iterations, open_ = rz * (min(tol, 1e-6) * 1e-4) ** 2, np.zeros(len(solved), int), rz > 0
    while open_.any() and iterations.max(initial=0) < maxiter:
        joined = cells
        for k in keys:
            joined = _inner(joined, state[k].select(*k, *(f"p{a}_{c}" for a in own[k] for c in solved)), list(k), sizes[k])
        for k in keys:
            q = joined.groupBy(*k).agg(*(F.sum(sum((m(a, b) * F.col(f"p{b}_{c}") for b in range(e)), F.lit(0.0))).alias(f"q{a}_{c}") for a in own[k] for c in solved))
            state[k] = checkpoint(state[k].join(q, list(k)))
        dq = summed(lambda k, c: sum((F.col(f"p{a}_{c}") * F.col(f"q{a}_{c}") for a in own[k]), F.lit(0.0)))
        step = np.where(open_ & (dq > 0), rz / np.where(dq > 0, dq, 1), 0.0)
        keep = lambda k: [*k, *parts(k), *(f"b{a}_{c}" for a in own[k] for c in solved)]
        for k in keys:
            state[k] = state[k].select(*keep(k), *(y for a in own[k] for c in solved for y in ((F.col(f"x{a}_{c}") + float(step[c]) * F.col(f"p{a}_{c}")).alias(f"x{a}_{c}"), (F.col(f"r{a}_{c}") - float(step[c]) * F.col(f"q{a}_{c}")).alias(f"r{a}_{c}"), f"p{a}_{c}")))
        new = summed(energy)
        iterations += open_
        open_ = open_ & (new > goal) & (dq > 0)
        ratio = np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0)
        for k in keys:
            solution = lambda c, k=k: _solved({a: F.col(f"r{a}_{c}") for a in own[k]})
            state[k] = state[k].select(*keep(k), *(y for c in solved for a, z in solution(c).items() for y in (f"x{a}_{c}", f"r{a}_{c}", (z + float(ratio[c]) * F.col(f"p{a}_{c}")).alias(f"p{a}_{c}"))))
        rz = new
    return state, iterations, not open_.any()


def _two_sets(cells, keys, own, state, sizes, names, solved, tol, maxiter) -> tuple[dict, np.ndarray, bool]:
    """The same for two sets of keys. The one with more groups is solved exactly in terms of the other, so that the
    iteration runs on the other's table alone. The cells are dealt by each set once; what moves in a step is one row of
    sums a cell and set at most. A step does what two iterations on both tables do, and counts as two."""
    one, two = sorted(keys, key=lambda k: -sizes[k])
    width, total = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), cells.count()
    m = lambda a, b: F.col(names.m(a, b))
    narrow = cells.select(*dict.fromkeys([*one, *two]), *dict.fromkeys(names.m(a, b) for a in own[one] for b in own[two]))

    def dealt(table: DataFrame, k: tuple[str, ...], most: int) -> DataFrame:
        """In order of the keys in partitions of their own; as it is where groups are broadcast or one has many rows."""
        ready = sizes[k] <= BROADCAST or most * width > max(4 * total, 1_000_000)
        return (table if ready else table.repartition(width, *k).sortWithinPartitions(*k)).persist()

    largest = {k: narrow.groupBy(*k).count().agg(F.max("count")).first()[0] or 0 for k in keys}
    side = {k: dealt(narrow, k, largest[k]) for k in keys}
    held = [*side.values(), dealt(state[one], one, 1)]
    factors = {k: [*(f"d{a}" for a in own[k]), *(f"l{a}_{b}" for a in own[k] for b in own[k] if b < a)] for k in keys}

    def through(values: DataFrame, k: tuple[str, ...], to: tuple[str, ...]) -> DataFrame:
        """The groups' values v{b}_{c} times the moments, as sums q{a}_{c} by the groups of the other set."""
        met = _inner(side[k], values, list(k), sizes[k])
        return met.groupBy(*to).agg(*(F.sum(sum((m(a, b) * F.col(f"v{b}_{c}") for b in own[k]), F.lit(0.0))).alias(f"q{a}_{c}") for a in own[to] for c in solved))

    def named(table: DataFrame, k: tuple[str, ...], name: str) -> DataFrame:
        return table.select(*k, *(F.col(f"{name}{a}_{c}").alias(f"v{a}_{c}") for a in own[k] for c in solved))

    def exact(table: DataFrame, k: tuple[str, ...], right) -> DataFrame:
        """The values that solve each group's block for right(a, c)."""
        return table.select(*k, *(z.alias(f"v{a}_{c}") for c in solved for a, z in _solved({a: right(a, c) for a in own[k]}).items()))

    def times(c: int) -> dict[int, Column]:
        """Each group's block times its p, by the block's factors."""
        z = {j: F.col(f"d{j}") * (F.col(f"p{j}_{c}") + sum((F.col(f"l{i}_{j}") * F.col(f"p{i}_{c}") for i in own[two] if i > j), F.lit(0.0))) for j in own[two]}
        return {i: z[i] + sum((F.col(f"l{i}_{k}") * z[k] for k in own[two] if k < i), F.lit(0.0)) for i in own[two]}

    def energy(k: tuple[str, ...], c: int, x: str, y: str) -> Column:
        solved_ = _solved({a: F.col(f"{y}{a}_{c}") for a in own[k]})
        return F.coalesce(F.sum(sum((F.col(f"{x}{a}_{c}") * solved_[a] for a in own[k]), F.lit(0.0))), F.lit(0.0))

    def read(table: DataFrame, *sums: Column) -> np.ndarray:
        return np.array(table.agg(*sums).first(), float).reshape(-1, len(solved))

    try:
        # what the smallest residual is measured against, as where nothing is eliminated
        goal = sum(read(state[k], *(energy(k, c, "r", "r") for c in solved))[0] for k in keys) * (min(tol, 1e-6) * 1e-4) ** 2
        rest = through(exact(held[2], one, lambda a, c: F.col(f"r{a}_{c}")), one, two)
        each = [(a, c) for a in own[two] for c in solved]
        met = state[two].join(rest, list(two)).select(*two, *factors[two], *(F.col(f"r{a}_{c}").alias(f"b{a}_{c}") for a, c in each), *((F.col(f"r{a}_{c}") - F.col(f"q{a}_{c}")).alias(f"r{a}_{c}") for a, c in each), *(F.lit(0.0).alias(f"x{a}_{c}") for a, c in each))
        now = checkpoint(met.select("*", *(z.alias(f"p{a}_{c}") for c in solved for a, z in _solved({a: F.col(f"r{a}_{c}") for a in own[two]}).items())))
        iterations, open_ = np.zeros(len(solved), int), read(now, *(energy(two, c, "r", "r") for c in solved))[0] > goal
        while open_.any() and iterations.max(initial=0) < maxiter:
            over = through(named(now, two, "p"), two, one)
            back = through(exact(held[2].select(*one, *factors[one]).join(over, list(one)), one, lambda a, c: F.col(f"q{a}_{c}")), one, two)
            sums = now.join(back, list(two))
            now = checkpoint(sums.select(*now.columns, *((z - F.col(f"q{a}_{c}")).alias(f"q{a}_{c}") for c in solved for a, z in times(c).items())))
            dot = [F.coalesce(F.sum(sum((F.col(f"p{a}_{c}") * F.col(f"q{a}_{c}") for a in own[two]), F.lit(0.0))), F.lit(0.0)) for c in solved]
            dq, rz, qz, qq = read(now, *dot, *(energy(two, c, x, y) for x, y in ("rr", "qr", "qq") for c in solved))
            step = np.where(open_ & (dq > 0), rz / np.where(dq > 0, dq, 1), 0.0)
            new = np.maximum(rz - 2 * step * qz + step * step * qq, 0)
            iterations += 2 * open_
            open_ = open_ & (new > goal) & (dq > 0)
            ratio = np.where(rz > 0, new / np.where(rz > 0, rz, 1), 0.0)
            keep = [*two, *factors[two], *(f"b{a}_{c}" for a, c in each)]
            now = now.select(*keep, *(y for a, c in each for y in ((F.col(f"r{a}_{c}") - float(step[c]) * F.col(f"q{a}_{c}")).alias(f"r{a}_{c}"), (F.col(f"x{a}_{c}") + float(step[c]) * F.col(f"p{a}_{c}")).alias(f"x{a}_{c}"), f"p{a}_{c}")))
            now = now.select(*keep, *(y for c in solved for a, z in _solved({a: F.col(f"r{a}_{c}") for a in own[two]}).items() for y in (f"r{a}_{c}", f"x{a}_{c}", (z + float(ratio[c]) * F.col(f"p{a}_{c}")).alias(f"p{a}_{c}"))))
        last = held[2].join(through(named(now, two, "x"), two, one), list(one))
        values = exact(last.select(*one, *factors[one], *((F.col(f"r{a}_{c}") - F.col(f"q{a}_{c}")).alias(f"g{a}_{c}") for a in own[one] for c in solved), *(F.col(f"r{a}_{c}").alias(f"b{a}_{c}") for a in own[one] for c in solved)), one, lambda a, c: F.col(f"g{a}_{c}"))
        solution = values.select(*one, *(F.col(f"v{a}_{c}").alias(f"x{a}_{c}") for a in own[one] for c in solved))
        found = {one: checkpoint(solution.join(held[2].select(*one, *(F.col(f"r{a}_{c}").alias(f"b{a}_{c}") for a in own[one] for c in solved)), list(one))), two: now}
    finally:
        for table in held:
            table.unpersist()
    return {k: found[k] for k in keys}, iterations, not open_.any()


def _factors(table: DataFrame, own: list[int]) -> DataFrame:
    """Each group's block m{a}_{b} (a >= b) as columns d{a} and l{a}_{b} of its factors L D L'; a direction that a group
    does not have gets d = 0."""
    for at, j in enumerate(own):
        done = own[:at]
        d = F.col(f"m{j}_{j}") - sum((F.col(f"l{j}_{k}") * F.col(f"l{j}_{k}") * F.col(f"d{k}") for k in done), F.lit(0.0))
        table = table.withColumn(f"d{j}", F.when(d > F.col(f"m{j}_{j}") * 1e-11, d).otherwise(0.0))
        for i in own[at + 1 :]:
            over = F.col(f"m{i}_{j}") - sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") * F.col(f"d{k}") for k in done), F.lit(0.0))
            table = table.withColumn(f"l{i}_{j}", F.when(F.col(f"d{j}") > 0, over / F.col(f"d{j}")).otherwise(0.0))
    return table


def _solved(r: dict[int, Column]) -> dict[int, Column]:
    """The exact solution of a group's block for a right side, by its factors."""
    own, y, z = list(r), {}, {}
    for at, j in enumerate(own):
        y[j] = r[j] - sum((F.col(f"l{j}_{k}") * y[k] for k in own[:at]), F.lit(0.0))
    for at in reversed(range(len(own))):
        j = own[at]
        z[j] = F.when(F.col(f"d{j}") > 0, y[j] / F.col(f"d{j}") - sum((F.col(f"l{i}_{j}") * z[i] for i in own[at + 1 :]), F.lit(0.0))).otherwise(0.0)
    return {j: z[j] for j in own}


def _prune_tables(cells: DataFrame, keys, rule: str) -> DataFrame:
    clean, k = 0, 0
    patience = len(keys) if rule == "fixed_point" else max(len(keys) - 1, 1)
    while clean < patience:
        key = list(keys[k % len(keys)])
        k += 1
        alone = checkpoint(cells.groupBy(*key).agg(F.sum("n").alias("alone")).where("alone = 1").drop("alone"))
        count = alone.count()
        if count:
            cells = checkpoint(cells.join(F.broadcast(alone) if count <= BROADCAST else alone, key, "left_anti"))
        clean = 0 if count else clean + 1
    return cells
