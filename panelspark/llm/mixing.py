"""Mixing of sources by temperature, to a target entropy or within a repetition limit.

The token share of each source is raised to an exponent between 0 (all sources alike) and 1 (as they are), and the
results are normalised to weights. Bisection finds the exponent: the largest one whose weights reach the target
entropy (given as a share of the highest possible), or, where the repetition limit binds earlier, the smallest one
at which no source is read more often than the limit. A token budget then gives each source its allotment.
Without a budget it is the least one that reads every source at least once, so that no row is left out.

An allotment is realised by block permutations: rows are dealt into blocks by a hash of their key (their number is a power of two); an epoch reads
all blocks of a source in an order drawn for that source and epoch, and within a block in an order of its own;
the last epoch stops where the allotment is met, within a block if need be. The row at which it stops is read whole.
Rows of one key stand at one place of the order; where an epoch stops among them, they are counted one by one.

DataFrame functions only. Results in odd cases: a null source is a source of its own; null and empty texts have no
tokens, and a source without tokens keeps its rows once; rows with a null key are ordered by their text's hash;
repeated rows are rows like others; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

#: Rows of a block, on average.
BLOCK = 1024
#: Blocks that stand side by side in an epoch and are summed first, so that no task orders all blocks of a source.
WIDE = 1024
#: So many sources are broadcast at most; more are joined by a shuffle.
SOURCES = 20_000
#: The exponent's range is cut into so many parts, so many times over; one aggregate measures all inner ends.
PARTS, STEPS = 4, 15


def n_tokens(text: Column) -> Column:
    """Words between blanks: cheap, and in proportion to the tokens of most vocabularies."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _weights(exponent: float) -> Column:
    return F.when(F.col("tokens") > 0, F.pow(F.col("share"), F.lit(exponent)))


def _measures(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent the entropy of the weights as a share of the highest, and how often the most repeated source is
    read for each time the least repeated one is; in one aggregate over the table of sources."""
    asked = []
    for a in exponents:
        w = _weights(a)
        asked += [F.count(w), F.sum(w), F.sum(w * F.ln(w)), F.max(w / F.col("share")), F.min(w / F.col("share"))]
    got, out = sources.agg(*asked).first(), []
    for i in range(0, len(asked), 5):
        n, z, wl, most, least = got[i : i + 5]
        out.append(((math.log(z) - wl / z) / math.log(n), most / least) if n and n >= 2 else (1.0, 1.0))
    return out


def bisect(sources: DataFrame, entropy: float | None, repeats: float | None) -> float:
    """The exponent, by cutting its range again and again."""

    def largest(good) -> float:
        # goodness holds below some exponent
        if good([1.0])[0]:
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(STEPS):
            ends = [low + (high - low) * i / PARTS for i in range(1, PARTS)]
            n = sum(good(ends))
            low, high = [low, *ends][n], [*ends, high][n]
        return low

    found = 1.0
    if entropy is not None:
        found = largest(lambda xs: [e >= entropy - 1e-12 for e, _ in _measures(sources, xs)])
    if repeats is not None and _measures(sources, [found])[0][1] > repeats:
        # fewer repeats at larger exponents
        least = 1.0 - largest(lambda xs: [r <= repeats for _, r in _measures(sources, [1.0 - x for x in xs])])
        found = max(found, least)
    return found


def _unit(*parts: Column) -> Column:
    """A number from 0 to 1 (exclusive), by hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _rank(block: Column, blocks: Column, *drawn_for: Column) -> Column:
    """The place of a block in a permutation of all blocks (a power of two), drawn by hash: two rounds of an odd
    multiple plus a constant, with the high half of the bits folded into the low half in between."""
    low = (1 << 31) - 1
    part = lambda k: F.xxhash64(F.lit(k), *drawn_for).bitwiseAND(low)
    step = lambda x, k: (x * part(k).bitwiseOR(F.lit(1)) + part(k + 1)).bitwiseAND(blocks - 1)
    first = step(block, 1)
    half = F.greatest(F.lit(1.0), F.ceil(F.log2(blocks) / 2))
    return step(first.bitwiseXOR(F.floor(first / F.pow(F.lit(2.0), half)).cast("long")), 3)


def plan(sizes: DataFrame, entropy: float | None = 0.98, repeats: float | None = 2.0, budget: int | None = None) -> DataFrame:
    """(source, tokens, n, weight, epochs) of each source, from rows with ``source`` and ``n_tokens``.

    ``epochs`` is how often the source is read, with its fraction.
    """
    totals = checkpoint(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")))
    count, whole = totals.agg(F.count("*"), F.sum("tokens")).first()
    # the measures below read this table once a step
    sources = checkpoint(totals.coalesce(max(1, count // SOURCES)).withColumn("share", F.col("tokens") / F.lit(whole or 1)))
    a = bisect(sources, entropy, repeats)
    w = _weights(a)
    z, ratio = sources.agg(F.sum(w), F.max(F.col("share") / w)).first()
    total = float(budget) if budget is not None else (whole or 0) * (ratio or 0.0) * (z or 0.0)
    weight = F.coalesce(w / F.lit(z or 1.0), F.lit(0.0))
    epochs = F.when(F.col("tokens") > 0, weight * F.lit(total) / F.col("tokens")).otherwise(F.lit(1.0))
    # the largest source is read once by definition; rounding must not cut its last row
    near = F.round(epochs)
    return sources.select("source", "tokens", "n", weight.alias("weight"), F.when(F.abs(epochs - near) < 1e-9, near).otherwise(epochs).alias("epochs"))


def _reached(sums: DataFrame, place: str) -> DataFrame:
    """Of each source the row at whose place the running sum of ``t`` reaches ``rest``, with ``left``: what it takes of it."""
    order = Window.partitionBy("source").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("before", F.coalesce(F.sum("t").over(order), F.lit(0)))
    return at.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest"))).withColumn("left", F.col("rest") - F.col("before"))


def _limits(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """(source, n_blocks, epochs, cut, cut_row, cut_left, cut_n) of each source: the last epoch reads the blocks placed
    before ``cut`` and, of the block at ``cut``, the rows placed before ``cut_row`` and those of the ``cut_n`` rows at
    it that begin within the next ``cut_left`` tokens."""
    s = sources.select("source", "tokens", "epochs", F.pow(F.lit(2.0), F.greatest(F.ceil(F.log2(F.col("n") / BLOCK)), F.lit(0))).cast("long").alias("n_blocks"))
    last = s.where(F.col("epochs") > F.floor("epochs")).select("source", "n_blocks", F.floor("epochs").cast("long").alias("epoch"), ((F.col("epochs") - F.floor("epochs")) * F.col("tokens")).alias("rest"))
    rows = _joined(sizes, last).select("source", "epoch", "rest", "n_blocks", F.pmod("row_hash", "n_blocks").alias("block"), "row_hash", "n_tokens").withColumn("place", _rank(F.col("block"), F.col("n_blocks"), F.lit(seed), F.col("source"), F.col("epoch")))
    blocks = checkpoint(rows.groupBy("source", "rest", "block", "place").agg(F.sum("n_tokens").alias("t"))).withColumn("wide", F.floor(F.col("place") / WIDE))
    # sums of neighbouring blocks are ordered within a source, then the blocks of the one where the epoch stops
    wide = _reached(blocks.groupBy("source", "rest", "wide").agg(F.sum("t").alias("t")), "wide")
    within = wide.select(F.col("source").alias("s1"), F.col("wide").alias("w1"), F.col("left").alias("rest"))
    near = blocks.drop("rest").join(within, F.col("source").eqNullSafe(F.col("s1")) & (F.col("wide") == F.col("w1")))
    cut = _reached(near, "place").select("source", "block", "place", "left")
    inner = rows.drop("rest").join(cut.select(F.col("source").alias("s2"), F.col("block").alias("b2"), "left"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    # rows of one key are one place
    places = inner.groupBy("source", "left", _unit(F.lit(seed), "epoch", "row_hash").alias("spot")).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("here"))
    by_place = Window.partitionBy("source").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    stop = places.withColumn("b", F.coalesce(F.sum("t").over(by_place), F.lit(0))).where(F.col("b") < F.col("left"))
    ends = stop.groupBy(F.col("source").alias("s3")).agg(F.max(F.struct("spot", (F.col("left") - F.col("b")).alias("left"), "here")).alias("e"))
    cuts = cut.select("source", F.col("place").alias("cut")).join(ends, F.col("source").eqNullSafe(F.col("s3")), "left").select(F.col("source").alias("s4"), "cut", F.col("e.spot").alias("cut_row"), F.col("e.left").alias("cut_left"), F.col("e.here").alias("cut_n"))
    return s.join(cuts, F.col("source").eqNullSafe(F.col("s4")), "left").select("source", "n_blocks", "epochs", "cut", "cut_row", "cut_left", "cut_n")


def _first_of(rows: DataFrame) -> DataFrame:
    """Of rows that stand at one place of their source, those that begin within ``__mix_cut_left`` tokens. They are
    counted within partitions, and partitions by their sums, so no task holds more than one partition's rows."""
    rows = checkpoint(rows).withColumn("__mix_part", F.spark_partition_id())
    part = Window.partitionBy("source", "__mix_part")
    before = rows.groupBy(F.col("source").alias("__mix_s"), F.col("__mix_part").alias("__mix_p")).agg(F.sum("__mix_tokens").alias("__mix_t"))
    parts = Window.partitionBy("__mix_s").orderBy("__mix_p").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("__mix_s", "__mix_p", F.coalesce(F.sum("__mix_t").over(parts), F.lit(0)).alias("__mix_before"))
    own = rows.withColumn("__mix_own", F.coalesce(F.sum("__mix_tokens").over(part.orderBy(F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = own.join(before, F.col("source").eqNullSafe(F.col("__mix_s")) & (F.col("__mix_part") == F.col("__mix_p")))
    return met.where(F.col("__mix_before") + F.col("__mix_own") < F.col("__mix_cut_left"))


def _joined(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns; the table of sources is broadcast where its size is within the bound."""
    named = sources.withColumnRenamed("source", "__own_source")
    small = sources.limit(SOURCES + 1).count() <= SOURCES
    return rows.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("__own_source"))).drop("__own_source")


def mix(docs: DataFrame, entropy: float | None = 0.98, repeats: float | None = 2.0, budget: int | None = None, seed: int = 1, tokens: Column | None = None, facts: bool = True) -> DataFrame:
    """The rows of the mixture: all columns of ``docs`` and, with ``facts``, ``mix_epoch``, ``mix_key`` (sorting by it
    reads the sources side by side in their weights) and ``mix_weight``, which replace columns of those names. A row
    stands once for each epoch that reads it."""
    own = [c for c in docs.columns if not facts or c not in ("mix_epoch", "mix_key", "mix_weight")]
    row_hash = F.xxhash64(F.coalesce("doc_id", F.xxhash64("text")), F.lit(seed))
    sizes = checkpoint(docs.select("source", row_hash.alias("row_hash"), (tokens if tokens is not None else n_tokens(F.col("text"))).alias("n_tokens")))
    sources = checkpoint(plan(sizes, entropy, repeats, budget))
    limits = checkpoint(_limits(sizes, sources, seed))
    weights = sources.select(F.col("source").alias("__w_source"), F.col("weight").alias("__mix_weight"))
    table = limits.join(weights, F.col("source").eqNullSafe(F.col("__w_source"))).select("source", F.col("n_blocks").alias("__mix_blocks"), F.col("epochs").alias("__mix_epochs"), F.col("cut").alias("__mix_cut"), F.col("cut_row").alias("__mix_cut_row"), F.col("cut_left").alias("__mix_cut_left"), F.coalesce("cut_n", F.lit(0)).alias("__mix_cut_n"), "__mix_weight")
    table = checkpoint(table)
    counted = tokens if tokens is not None else n_tokens(F.col("text"))
    rows = _joined(docs.select(*(F.col(f"`{c}`") for c in own)), table)
    rows = rows.withColumn("__mix_hash", row_hash).where("__mix_epochs > 0")
    rows = rows.withColumn("__mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil("__mix_epochs").cast("long") - 1, F.lit(0).cast("long")))))
    place = _rank(F.pmod("__mix_hash", "__mix_blocks"), F.col("__mix_blocks"), F.lit(seed), F.col("source"), F.col("__mix_epoch"))
    spot = _unit(F.lit(seed), "__mix_epoch", "__mix_hash")
    rows = rows.withColumn("__mix_place", place).withColumn("__mix_spot", spot)
    whole, at_cut, at_row = F.col("__mix_epoch") + 1 <= F.col("__mix_epochs"), F.col("__mix_place") == F.col("__mix_cut"), F.col("__mix_spot") == F.col("__mix_cut_row")
    read = F.coalesce(whole | (F.col("__mix_place") < F.col("__mix_cut")) | (at_cut & (F.col("__mix_spot") <= F.col("__mix_cut_row"))), F.lit(False))
    # places are even over an epoch, so the share of it that lies before a row tells when the row is due
    key = F.least(F.lit(1.0), (F.col("__mix_epoch") + (F.col("__mix_place") + F.col("__mix_spot")) / F.col("__mix_blocks")) / F.greatest("__mix_epochs", F.lit(1e-12)))
    shown = [F.col("__mix_epoch").alias("mix_epoch"), key.alias("mix_key"), F.col("__mix_weight").alias("mix_weight")] if facts else []
    out = [*(F.col(f"`{c}`") for c in own), *shown]
    if not table.where("__mix_cut_n > 1").limit(1).count():
        return rows.where(read).select(*out)
    shared = F.coalesce(~whole & at_cut & at_row & (F.col("__mix_cut_n") > 1), F.lit(False))
    some = _first_of(rows.where(shared).withColumn("__mix_tokens", counted))
    return rows.where(read & ~shared).select(*out).unionByName(some.select(*out))
