"""SimHash near-duplicates found by deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two fingerprints with at most ``max_bits`` differing bits
have a segment that differs in one bit at most (three segments for four bits). Every fingerprint is indexed under
each segment with each single bit of it left out; two fingerprints within the distance then share at least one
such key, whatever the bits are. Members of a key are compared exactly.

``near_copies`` decides by the texts' sets of shingles instead: pairs whose likeness (Jaccard) reaches a bound. At 0.8
a seventh of all bits differ, which no fingerprint of 64 bits can find by segments. So it takes a wide fingerprint of
the set, cut into segments whose width follows the number of rows and whose number follows from the share of pairs at
the bound that may be missed: a pair is found if one of its segments differs in one bit at most. A segment's variants
with one bit left out are joined within the group of rows that have one half of the segment in common, as one of the
two halves must be equal. Candidates pass a comparison of 128 bits, and every link is decided on the whole sets, which
travel once: to the place of the cluster that candidates join.

Results in odd cases: null and wordless texts have fingerprint zero and are linked like any other; texts shorter
than a shingle are one shingle of all their words; equal texts have equal fingerprints and need no comparison; a row
without doc_id has the component of the rows of its fingerprint that have one (null if none has), but joins no others;
repeated rows are kept; an empty table gives an empty table; further columns of the input are not carried along.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, over_texts, tasks
from .components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Members of a key that one task compares at once; larger keys are cut into blocks and compared block by block.
BLOCK = 4096
#: So many keys over the block size are broadcast at most; more are joined by a shuffle.
HOT_KEYS = 100_000
#: Groups up to this size are compared by shifted copies of the whole batch, larger ones by a search from each member.
SMALL = 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of the XXH64 values (seed 42) of all word shingles, repeats included."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - shingle].tolist()]
    stops = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprints(shingle: int):
    def make():
        def f(texts: list) -> dict:
            h = [fingerprint(t, shingle) for t in texts]
            return {"fingerprint": [x - (1 << 64) if x >> 63 else x for x in h]}

        return f

    return make


def segments(bits: int, max_bits: int) -> list[tuple[int, int]]:
    """(start, width) of the fewest segments of which one must differ in one bit at most."""
    n = max_bits // 2 + 1
    edges = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _search(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """A spanning forest of the links in one group: each member is reached once, from a member already reached."""
    rest, found = np.arange(len(prints)), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]) <= max_bits
            if near.any():
                new = rest[near]
                found += [(at, x) for x in new.tolist()]
                front += new.tolist()
                rest = rest[~near]
    return found


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: np.ndarray, prints: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
            a, b = [], []
            cut = np.flatnonzero(np.diff(key, axis=0).any(axis=1)) + 1
            size = np.diff(np.concatenate([[0], cut, [len(key)]]))
            start = np.concatenate([[0], cut]).astype(np.int64)
            small = np.repeat(size <= SMALL, size)
            group = np.repeat(np.arange(len(size)), size)
            for d in range(1, min(SMALL, len(key))):
                i = np.flatnonzero((group[:-d] == group[d:]) & small[d:])
                if not len(i):
                    break
                i = i[np.bitwise_count(prints[i] ^ prints[i + d]) <= max_bits]
                a.append(rep[i])
                b.append(rep[i + d])
            for s, n in zip(start[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
                if pairs := _search(prints[s : s + n], max_bits):
                    p = np.array(pairs) + s
                    a.append(rep[p[:, 0]])
                    b.append(rep[p[:, 1]])
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("key", "tile", "print", "rep")]
            rows = [np.stack(cols[:2], axis=1), cols[2].view(np.uint64), cols[3]]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            same = (held[0] == held[0][-1]).all(axis=1)
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:  # the last group may go on in the next batch; a group has two blocks at most
                yield done(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield done(*held)

    return run


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint as signed long) of each row."""
    return docs.select("doc_id", over_texts(_fingerprints(shingle), "fingerprint long", "text").alias("r")).select("doc_id", "r.fingerprint")


def near_links(prints: DataFrame, max_bits: int = 4, block: int = BLOCK) -> DataFrame:
    """(a, b): links between classes, enough to connect all classes that links connect.

    ``prints`` has one row a class: ``fingerprint`` and ``rep``. A group that shares a key gives a spanning
    forest of its links, never all its pairs. A key with more than ``block`` members is cut into blocks by a hash
    of the member, and each pair of blocks is compared in a task of its own.
    """
    p = F.col("fingerprint")
    keys = []
    for k, (start, width) in enumerate(segments(64, max_bits)):
        part = F.shiftrightunsigned(p, start).bitwiseAND((1 << width) - 1)
        # segment number, bit left out, and the other bits; both numbers stay clear of the segment's bits
        keys += [part.bitwiseAND(((1 << width) - 1) ^ (1 << j)) + F.lit((k * 64 + j) << 40) for j in range(width)]
    rows = prints.select("rep", p.alias("print"), F.explode(F.array(*keys)).alias("key"))
    n = prints.count()
    dealt = _dealt(rows, "rep", block, tasks(prints.sparkSession, n * 64)).sortWithinPartitions("key", "tile", "print")
    return dealt.mapInArrow(_links(max_bits), "a long, b long").distinct()


def _dealt(rows: DataFrame, member: str, block: int, width: int, weight: Column | None = None) -> DataFrame:
    """Rows with ``tile``, in ``width`` partitions by key and tile: 0, or where a key has more than ``block`` members
    (or members' ``weight``), each pair of its blocks (by a hash of the member) that the row belongs to."""
    much = F.count("*") if weight is None else F.greatest(F.count("*"), F.ceil(F.sum(weight)))
    hot = checkpoint(rows.groupBy("key").agg(much.alias("n")).where(F.col("n") > block))
    few = hot.count() <= HOT_KEYS
    shared = rows.join(F.broadcast(hot) if few else hot, "key", "left")
    blocks = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(block)).cast("long")
    own, zero = F.pmod(F.xxhash64(member), F.col("blocks")), F.lit(0).cast("long")
    pair = lambda o: F.least(o, F.col("own")) * F.col("blocks") + F.greatest(o, F.col("own"))
    every = F.when(F.col("blocks") == 1, F.array(zero)).otherwise(F.transform(F.sequence(zero, F.col("blocks") - 1), pair))
    tiles = shared.withColumn("blocks", blocks).withColumn("own", own).select(*rows.columns, F.explode(every).alias("tile"))
    return tiles.repartition(width, "key", "tile")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id that links reach."""
    prints = checkpoint(fingerprints(docs, shingle))
    # a class is a few bytes but has 64 keys, so classes are spread by number, not by size
    width = tasks(docs.sparkSession, prints.count() * 64)
    classes = checkpoint(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")).repartition(width, "fingerprint"))
    parts = connected_components(near_links(classes, max_bits))
    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fingerprint", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by likeness of sets --------------------------------------------------------------------------

#: The least likeness of near copies, as a fraction, and the words of a shingle.
OVER, UNDER, WORDS = 4, 5, 5
#: Of pairs of just that likeness, so many may have no segment that differs in one bit at most.
MISSED = 0.005
#: Longs that a fingerprint has at least, and those that go with each half and are compared before the sets are.
SKETCH, SENT = 4, 2
#: Members of a half segment that one task compares at once, and the shingles that it holds for a crowd of them.
CROWD, HELD = 4096, 4 << 20
#: Bytes of sets that a task of pairs holds of each side, and pairs that it decides, on average; so many classes are
#: broadcast at most to find their texts.
BUCKET, TILE, FEW = 16 << 20, 4_000, 200_000
#: Links that one task reduces to a forest.
EDGES = 250_000
#: Shingles that are hashed into a fingerprint at once.
STEP = 512


def differing() -> float:
    """The share of bits that differ, on average, between sets of just the least likeness."""
    return math.acos(2 * OVER / (UNDER + OVER)) / math.pi


def cut(rows: int) -> tuple[int, int]:
    """(half width, number) of segments: as wide as leaves few members that agree by chance, and as many as find all
    but MISSED of the pairs of just the least likeness."""
    half = max(7, math.ceil((math.log2(max(rows, 1)) + 2) / 2))
    p, w = differing(), 2 * half
    met = (1 - p) ** w + w * p * (1 - p) ** (w - 1)
    return half, max(math.ceil(math.log(MISSED) / math.log(1 - met)), -(-SKETCH * 64 // w))


def reach(longs: int = SKETCH) -> int:
    """Bits of so many longs that pairs of the least likeness differ in at most, but for one in some thousands."""
    p, n = differing(), 64 * longs
    return math.ceil(n * p + 3.5 * math.sqrt(n * p * (1 - p)))


def shingles(text: str | None, shingle: int = WORDS) -> np.ndarray:
    """The different XXH64 values (seed 42) of a text's word shingles, sorted."""
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[shingle - 1 :].tolist() or [len(line)]
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    return np.unique(np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops)))


def wide(x: np.ndarray, longs: int) -> bytes:
    """The SimHash of a set of hashes in so many longs; each long takes bits of a mixture of its own."""
    ones = np.zeros(64 * longs, np.int64)
    salt = np.arange(1, longs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(x), STEP):
        h = x[at : at + STEP, None] ^ salt
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(x), bitorder="little").tobytes()


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    if min(len(a), len(b)) * UNDER < max(len(a), len(b)) * OVER:
        return False
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return UNDER * common >= OVER * (len(a) + len(b) - common)


def identity(docs: DataFrame) -> list[Column]:
    """What tells rows of a group apart: the id and two hashes of the text."""
    return [F.col("doc_id"), F.xxhash64("text").alias("h1"), F.hash("text").alias("h2")]


def same(a: DataFrame, b: DataFrame) -> Column:
    return a["h1"].eqNullSafe(b["h1"]) & a["h2"].eqNullSafe(b["h2"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _sketched(shingle: int, longs: int):
    def make():
        def f(texts: list) -> dict:
            sets = [shingles(t, shingle) for t in texts]
            return {"node": np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in sets], np.uint64).view(np.int64).tolist(), "size": [len(x) for x in sets], "print": [wide(x, longs) for x in sets]}

        return f

    return make


def _halves(half: int, number: int):
    """Rows of (node, size, print) to a row for each half of each segment: that half as key, the other beside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.int64(1) << np.arange(half, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                m = part.num_rows
                raw = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint8).reshape(m, -1)
                bits = np.unpackbits(raw, axis=1, bitorder="little")[:, : 2 * half * number].reshape(m, number, 2, half)
                value = bits @ powers
                key = value + (np.arange(2 * number, dtype=np.int64).reshape(number, 2) << 32)
                sketch = raw.view(np.int64)[:, :SENT]
                each = lambda c, part=part: np.repeat(part.column(c).to_numpy(zero_copy_only=False), 2 * number)
                cols = [key.reshape(-1), value[:, :, ::-1].reshape(-1), each("size"), each("node"), *(np.repeat(sketch[:, k], 2 * number) for k in range(SENT))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "other", "size", "node", *(f"s{k}" for k in range(SENT))])

    return run


def _met(start: np.ndarray, other: np.ndarray, half: int, near) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j) of rows of one group (``start`` numbers the groups) whose ``other`` differ in one bit at most
    and that are ``near``, by equality of the variants with one bit left out. Of variants with more than SMALL rows no
    pairs are given, but the rows that are near another one."""
    a, b, crowd = [], [], np.zeros(len(start), bool)
    for k in range(half):
        code = (start << half) | (other & ~(1 << k))
        order = np.argsort(code, kind="stable")
        runs = np.flatnonzero(np.diff(code[order], prepend=code[order[0]] - 1))
        size = np.diff(np.append(runs, len(order)))
        run, small = np.repeat(np.arange(len(runs)), size), np.repeat(size <= SMALL, size)
        for d in range(1, min(int(size.max()), SMALL)):
            at = np.flatnonzero((run[:-d] == run[d:]) & small[d:])
            i, j = order[at], order[at + d]
            ok = near(i, j)
            a.append(i[ok])
            b.append(j[ok])
        for r in np.flatnonzero(size > SMALL).tolist():
            own = order[runs[r] : runs[r] + size[r]]
            step = max(1, (1 << 20) // len(own))
            for at in range(0, len(own), step):
                i = own[at : at + step]
                crowd[i] |= (near(i[:, None], own[None, :]) & (i[:, None] != own[None, :])).any(axis=1)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), np.flatnonzero(crowd)


def _candidates(half: int):
    """Pairs of nodes that may be alike (a, b, null), and the members of crowds in which any two may be (node, null,
    crowd): never more rows than a few times the rows that came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = reach(SENT)

        def done(key, other, size, node, sketch) -> pa.RecordBatch:
            start = np.cumsum(np.diff(key, axis=0, prepend=key[:1]).any(axis=1)).astype(np.int64)

            def near(i, j):
                far = np.zeros(np.broadcast_shapes(i.shape, j.shape), np.int16)
                for s in sketch:
                    far += np.bitwise_count(s[i] ^ s[j])
                return (far <= most) & (np.minimum(size[i], size[j]) * UNDER >= np.maximum(size[i], size[j]) * OVER)

            i, j, many = _met(start, other, half, near)
            x, y = node[i], node[j]
            both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            # a crowd is named by its key and tile; two of one name are looked through together
            name = key[many, 0] ^ (key[many, 1] << 40)
            pair = np.repeat([False, True], [len(both), len(many)])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([both[:, 0], node[many]])), pa.array(np.concatenate([both[:, 1], name]), mask=pair), pa.array(np.concatenate([both[:, 1], name]), mask=~pair)], names=["a", "b", "crowd"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda c, batch=batch: batch.column(c).to_numpy(zero_copy_only=False)
            rows = [np.stack([col("key"), col("tile")], axis=1), col("other"), col("size"), col("node"), *(col(f"s{k}") for k in range(SENT))]
            held = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            same = (held[0] == held[0][-1]).all(axis=1)
            last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if last:  # the last group may go on in the next batch; a group has two blocks at most
                yield done(*(x[:last] for x in held[:4]), [x[:last].view(np.uint64) for x in held[4:]])
                held = [x[last:] for x in held]
        if held is not None:
            yield done(*held[:4], [np.ascontiguousarray(x).view(np.uint64) for x in held[4:]])

    return run


def _decide(sets: pa.Table, pairs: pa.Table) -> pa.Table:
    """The pairs of a tile that are alike, by their whole sets."""
    held = {n: np.frombuffer(s, np.uint64) for n, s in zip(sets.column("node").to_pylist(), sets.column("set").to_pylist(), strict=True)}
    a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
    yes = np.array([alike(held[x], held[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], bool)
    return pa.table({"a": a[yes], "b": b[yes]})


def _crowd(members: pa.Table) -> pa.Table:
    """(a, b): of all that pairs of a crowd alike by their whole sets join, one and each of the others. Each member is
    looked up once in an index of the shingles of those that no member reached yet."""
    found = dict(zip(members.column("node").to_pylist(), members.column("set").to_pylist(), strict=True))
    node, sets = np.array(list(found), np.int64), [np.frombuffer(x, np.uint64) for x in found.values()]
    m, size = len(node), np.array([len(x) for x in sets])
    owner, (_, word) = np.repeat(np.arange(m), size), np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)])
    order = np.argsort(word, kind="stable")
    rest, indexed, a, b = np.ones(m, bool), 2 * m + 1, [], []
    for start in range(m):
        if not rest[start]:
            continue
        rest[start], front = False, [start]
        while front and rest.any():
            if 2 * rest.sum() < indexed:  # the index holds twice as many as are left at most
                indexed, kept = int(rest.sum()), order[rest[owner[order]]]
                ends = np.cumsum(np.bincount(word[kept], minlength=int(word.max()) + 1))
                members_of, begins = owner[kept], np.concatenate([[0], ends[:-1]])
            at = front.pop()
            own = word[first[at] : first[at + 1]]
            lengths = ends[own] - begins[own]
            places = np.repeat(begins[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            common = np.bincount(members_of[places], minlength=m)
            new = np.flatnonzero(rest & (UNDER * common >= OVER * (size[at] + size - common)))
            rest[new] = False
            a.append(np.full(len(new), start))
            b.append(new)
            front += new.tolist()
    none = np.empty(0, np.int64)
    return pa.table({"a": node[np.concatenate([none, *a])], "b": node[np.concatenate([none, *b])]})


def _alike_pairs(pairs: DataFrame, sets: DataFrame, buckets: int) -> DataFrame:
    """The pairs that are alike. Nodes are dealt into buckets and pairs into tiles of two buckets; a set travels to a
    tile once, however many pairs it has there."""
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
    # a pair's ends are ordered by bucket within its tile, so that each tile stands once
    tile = F.least(bucket("a"), bucket("b")) * F.lit(buckets) + F.greatest(bucket("a"), bucket("b"))
    tiled = pairs.select(tile.alias("tile"), "a", "b")
    needed = tiled.select(F.col("tile").alias("to"), F.explode(F.array("a", "b")).alias("node")).distinct()
    sent = needed.join(sets, "node").select(F.col("to").alias("place"), "node", "set")
    return sent.groupBy("place").cogroup(tiled.groupBy("tile")).applyInArrow(_decide, "a long, b long")


def _sets(shingle: int):
    """Rows of (cluster, node, text) to the text's set, of repeats in a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                new = [k for k, x in enumerate(part.column("node").to_pylist()) if not (x in seen or seen.add(x))]
                part = part.take(pa.array(new, pa.int64()))
                sets = pa.array([shingles(x, shingle).tobytes() for x in part.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("cluster"), part.column("node"), sets], names=["cluster", "node", "set"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links as few as join what they join: each end with a smaller one that it reaches."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.get(x, x)) != x:
            above[x] = x = above.get(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    ends = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64()), pa.array([top(x) for x in ends], pa.int64())], names=["a", "b"])


def _clusters(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(cluster, node, who, large) of each class that is in a pair or crowd: the cluster that these join, and whether it
    is more than one task compares at once. A crowd's name stands as one more end of links; should it be a node's, two
    clusters are one."""
    links = found.select("a", F.coalesce("b", "crowd").alias("b")).coalesce(max(1, -(-found.count() // EDGES)))
    parts = connected_components(links.mapInArrow(_forest, "a long, b long"))
    rows = checkpoint(parts.withColumnRenamed("component", "cluster").join(classes, "node").select("cluster", "node", "size", "who.*"))
    much = F.greatest(F.count("*"), F.ceil(F.sum(F.col("size") * CROWD / HELD)))
    large = rows.groupBy("cluster").agg(much.alias("n")).where(F.col("n") > CROWD).select("cluster", F.lit(True).alias("large"))
    return checkpoint(rows.join(large, "cluster", "left").withColumn("large", F.coalesce("large", F.lit(False))))


def _links_of_large(pairs: DataFrame, crowds: DataFrame, wanted: DataFrame, sets: DataFrame) -> DataFrame:
    """Links within clusters that no task can hold: pairs in tiles, and crowds each in a task."""
    sets, mine = checkpoint(sets.dropDuplicates(["node"]).select("node", "set")), wanted.select("node")
    pairs, crowds = checkpoint(pairs.join(mine, pairs["a"] == mine["node"], "left_semi")), crowds.join(mine, "node", "left_semi")
    total = wanted.agg(F.coalesce(F.sum("size"), F.lit(0)) * 8).first()[0]
    few = _alike_pairs(pairs, sets, max(1, -(-total // BUCKET), math.ceil(math.sqrt(2 * pairs.count() / TILE))))
    return few.unionByName(crowds.join(sets, "node").select("crowd", "node", "set").groupBy("crowd").applyInArrow(_crowd, "a long, b long"))


def near_copies(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """(doc_id, h1, h2, group) of every row; rows of one group are joined by links, which are pairs of texts whose sets
    of word shingles have at least OVER / UNDER in common.

    Texts of equal sets are one class. Wordless texts are a class that links with nothing else. Few candidates with the
    same variant are pairs; more are a crowd. What pairs and crowds join is a cluster, whose sets meet in one task that
    finds all its links. Only where that is more than a task can hold, sets go to each tile of pairs and each crowd
    (of a pair of blocks, where a half segment has many members) that they are in.
    """
    spark = docs.sparkSession
    half, number = cut(docs.count())
    longs = -(-2 * half * number // 64)
    sketch = over_texts(_sketched(shingle, longs), "node long, size int, print binary", "text").alias("r")
    rows = checkpoint(docs.select(*identity(docs), sketch).select("doc_id", "h1", "h2", "r.*"))
    classes = rows.groupBy("node").agg(F.first("size").cast("long").alias("size"), F.first("print").alias("print"), F.min(F.struct("doc_id", "h1", "h2")).alias("who"))
    n = rows.count() * 2 * number
    classes = checkpoint(classes.repartition(tasks(spark, n), "node"))
    halves = classes.where("size > 0").select("node", "size", "print").mapInArrow(_halves(half, number), "key long, other long, size long, node long, " + ", ".join(f"s{k} long" for k in range(SENT)))
    dealt = _dealt(halves, "node", CROWD, tasks(spark, n), F.col("size") * CROWD / HELD).sortWithinPartitions("key", "tile")
    found = checkpoint(dealt.mapInArrow(_candidates(half), "a long, b long, crowd long"))
    pairs = checkpoint(found.where("b is not null").select("a", "b").distinct())
    crowds = found.where("crowd is not null").select("crowd", F.col("a").alias("node"))
    wanted = _clusters(found, classes)
    many, huge = wanted.agg(F.count("*"), F.count_if("large")).first()
    texts = docs.select(*identity(docs), "text")

    def sets(rows: DataFrame) -> DataFrame:
        met = texts.join(F.broadcast(rows) if many <= FEW else rows, same(texts, rows)).select("cluster", "node", "text")
        return met.mapInArrow(_sets(shingle), "cluster long, node long, set binary")

    links = sets(wanted.where("not large")).groupBy("cluster").applyInArrow(_crowd, "a long, b long")
    if huge:
        large = wanted.where("large")
        links = links.unionByName(_links_of_large(pairs, crowds, large, sets(large)))
    parts = connected_components(links)
    return rows.join(parts, "node", "left").select("doc_id", "h1", "h2", F.coalesce("component", "node").alias("group"))
