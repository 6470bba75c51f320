"""Helpers shared by the operators: checkpoints, batch functions over texts, bounded training samples."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts handed to a batch function at once; Arrow batches are cut to it so that memory stays bounded by long texts.
STEP = 256


#: What a worker keeps between tasks, by key, and the keys that the present task has asked for.
KEPT: dict = {}
USED: set = set()


def kept(key, build: Callable):
    """The value of a key, built once a worker and kept as long as its tasks ask for it."""
    USED.add(key)
    if key not in KEPT:
        KEPT[key] = build()
    return KEPT[key]


def started(make: Callable) -> Callable:
    """The batch function of a new task. What earlier operators have left in this worker gives way."""
    USED.clear()
    f = make()
    for key in KEPT.keys() - USED:
        del KEPT[key]
    return f


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a folder of our own only where none is set and all tasks run
    on this machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder, so that lost executors cost no more than one step."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def tasks(spark: SparkSession, rows: int, most: int = 2_000_000, least: int = 20_000) -> int:
    """How many tasks share so many short rows: the session's number of shuffle partitions, fewer where that would
    leave a task under ``least`` rows, more where it would be given over ``most``."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-rows // most), min(width, -(-rows // least)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_type(schema: T.StructType) -> pa.StructType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.struct([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])


def over_texts(make: Callable[[], Callable[[list], list[dict] | dict]], schema: str, *columns: Column | str) -> Column:
    """A struct column of what a batch function returns.

    ``make`` runs once a task and returns the function; that one gets the list of values of the first
    column (None where null) and of the further columns, and returns a dict of equally long lists.
    """
    fields = T._parse_datatype_string(schema)

    @F.arrow_udf(fields)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        to = arrow_type(fields)
        f = started(make)
        for arrays in batches:
            arrays = arrays if isinstance(arrays, tuple) else (arrays,)
            n, parts = len(arrays[0]), []
            for at in range(0, n, STEP):
                out = f(*(a.slice(at, STEP).to_pylist() for a in arrays))
                parts.append(pa.StructArray.from_arrays([pa.array(out[x.name], type=x.type) for x in to], fields=list(to)))
            yield pa.concat_arrays(parts) if parts else pa.array([], type=to)

    if len(columns) == 1:
        one = run.func

        @F.arrow_udf(fields)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from one(batches)

    return run(*columns)


def remainder(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int, kind: str = "int") -> DataFrame:
    """At most ``rows`` texts with their label: those whose key has the smallest hash.

    The order is by a hash of the key, so the sample is even over sources and the same in every run. Only keys
    and labels are sorted; texts are read by a join with the sample, which ``rows`` bounds. Texts over
    ``max_chars`` code points are left out of training (never out of prediction). A key that is labelled twice has its
    smaller label, one with several texts trains with the smallest of them.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast(kind).alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
