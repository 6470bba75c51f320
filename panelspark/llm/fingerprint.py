"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Every word shingle is hashed once. The high bits of a hash name its bin, the least hash of each bin is kept, and
an empty bin takes the value of the first filled bin in an order drawn at random for that bin (the same for all
texts). The low byte of each of the 128 values is packed into the fingerprint. Two unrelated values agree in their
low byte by chance once in 256, which the estimate of likeness corrects. DataFrame functions only.

Results in odd cases: a null text counts as empty; texts without words have the fingerprint of no shingle
(all bins empty, packed as zeros); a text of fewer words than a shingle is one shingle; repeated rows are kept;
rows with a null key sort first; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of a fingerprint and bits kept of each.
BINS, BITS = 128, 8
SHINGLE = 5
#: Probes of an empty bin that are tried one by one before all are searched.
PROBES = 6
BLANK = r"[\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _mix(a: int, b: int) -> int:
    """A pair's 64-bit hash, by the finaliser of splitmix64."""
    z = (a * 0x9E3779B97F4A7C15 + b * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = ((z ^ (z >> shift)) * factor) & (2**64 - 1)
    return z ^ (z >> 31)


def _donors() -> Column:
    """For each bin, all bins in the order in which it looks for a value: itself, then the others at random."""
    rows = [[i, *sorted((j for j in range(BINS) if j != i), key=lambda j: _mix(i, j))] for i in range(BINS)]
    return F.array(*(F.array(*map(F.lit, row)) for row in rows))


def _hex_bytes() -> Column:
    return F.array(*(F.lit(f"{i:02x}") for i in range(1 << BITS)))


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text as a string of hexadecimal digits, two a bin."""
    shift = 64 - BINS.bit_length() + 1
    # the largest hash of a bin stands for an empty bin
    top = (1 << shift) - 1
    empty = F.array(*(F.lit(((b << shift) | top) - ((1 << 64) if b >= BINS // 2 else 0)) for b in range(BINS)))
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + k)
        many = F.transform(F.sequence(F.lit(0), F.size(h) - shingle), lambda i: F.xxhash64(*(at(i, k) for k in range(shingle))))
        few = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        return F.when(F.size(h) >= shingle, many).otherwise(few)

    bin_of = lambda x: F.shiftrightunsigned(x, shift)
    # sorted by hash, so each bin's first is its least; in order of signed numbers, the upper half of the bins comes first
    firsts = let(F.sort_array(F.concat(let(hashed, shingles), empty)), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    half = BINS // 2
    value = lambda v, b: F.get(v, F.pmod(b + half, F.lit(BINS)))
    found = lambda x: F.when(x.bitwiseAND(top) != top, x)

    def densify(v: Column) -> Column:
        def one(row: Column) -> Column:
            near = [found(value(v, F.get(row, F.lit(k)))) for k in range(PROBES)]
            rest = F.get(F.filter(F.transform(row, lambda b: found(value(v, b))), lambda x: x.isNotNull()), F.lit(0))
            return F.coalesce(*near, rest, F.lit(0).cast("bigint"))

        return F.transform(_donors(), one)

    pack = lambda d: F.array_join(F.transform(d, lambda x: F.get(_hex_bytes(), x.bitwiseAND((1 << BITS) - 1).cast("int"))), "")
    filled = let(firsts, lambda v: F.when(F.exists(v, lambda x: x.bitwiseAND(top) != top), pack(densify(v))).otherwise(F.lit("00" * BINS)))
    return filled


def likeness(a: Column, b: Column) -> Column:
    """The estimated share of shingles in common, 0 to 1, from two fingerprints."""
    chance = 1.0 / (1 << BITS)
    agree = F.size(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.substring(a, i * 2 + 1, F.lit(2)) == F.substring(b, i * 2 + 1, F.lit(2)))) / F.lit(float(BINS))
    return F.greatest(F.lit(0.0), (agree - chance) / (1 - chance))


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Each row with a struct ``next``: the given columns of the row that follows by ascending doc_id (after the
    last: the first).

    Rows are dealt once, into ranges of doc_id bounded by values that occur (approximate quantiles of the key
    column alone). The first rows of a range are also sent to the range before it, as ghosts, so no row needs
    another range. Ranges are sorted and read in order with spilling; none has to fit in memory.
    """
    key = F.coalesce("doc_id", F.lit(-(2**63))).alias("key")
    cuts = docs.select(key).agg(F.min("key").alias("low"), F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 100_000).alias("cuts")).first()
    splits = sorted({cuts["low"], *(cuts["cuts"] or [])} - {None}) or [0]
    last = len(splits) - 1
    bounds = F.array(*(F.lit(x).cast("bigint") for x in splits))
    # the number of bounds at or below the key, by halving
    def further(step: int):
        return lambda p: F.when((p + step <= last) & (F.get(bounds, F.least(p + step, F.lit(last))) <= F.col("key")), p + step).otherwise(p)

    at: Column = F.lit(0)
    step = 1 << last.bit_length()
    while step := step // 2:
        at = let(at, further(step))
    rows = docs.withColumn("key", key).withColumn("at", at)
    first = F.get(bounds, F.col("at")) == F.col("key")
    place = lambda to, ghost: F.struct(to.alias("range"), F.lit(ghost).alias("ghost"))
    before = F.when(F.col("at") == 0, last).otherwise(F.col("at") - 1)
    kept = [c for c in docs.columns if c not in columns]
    # the columns travel in one struct, so that the window reads them where they are instead of copying them
    dealt = rows.select(*kept, "key", F.xxhash64(*columns).alias("tie"), F.struct(*columns).alias("row"), F.explode(F.when(first, F.array(place(F.col("at"), False), place(before, True))).otherwise(F.array(place(F.col("at"), False)))).alias("to"))
    w = Window.partitionBy("range").orderBy("ghost", "key", "tie")
    out = dealt.select(*kept, "key", "tie", "row", F.col("to.range").alias("range"), F.col("to.ghost").alias("ghost"))
    return out.withColumn("next", F.lead("row").over(w)).where(~F.col("ghost")).select(*kept, "row.*", "next")


def edited(text: Column, following: Column) -> Column:
    """The text with its last half (rounded down) replaced by as many first code points of the following text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row."""
    buckets = buckets or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # packed as bytes while it is moved
    marked = texts.withColumn("print", F.unhex(fingerprint(F.col("text"))))
    both = with_next(marked, ["text", "print"], buckets).select("doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "print", edited(F.col("text"), F.col("next.text")).alias("edited"), F.col("next.print").alias("next_print"))
    shown = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.lower(F.hex("print")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"), F.lower(F.hex("next_print")).alias("next_fingerprint"))
    return shown.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
