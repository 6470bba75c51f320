"""Reading and writing tables, and cutting lineages."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A table from Parquet, ORC, JSON or CSV files (header and types are taken from the file); the format is told by
    the path's ending unless given."""
    kind = format or next((f for f in ("parquet", "orc", "json", "csv") if path.rstrip("/").endswith(f".{f}")), "parquet")
    reader = spark.read.options(**({"header": True, "inferSchema": True} if kind == "csv" else {}) | options)
    return reader.format(kind).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Writes a result, for example residuals or effects, as files."""
    w = df.write.mode(mode).format(format)
    if format == "csv":
        w = w.option("header", True)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def need_table(df) -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a DataFrame, not {type(df).__name__}")
    return df


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder of spark.checkpoint.dir; a folder of our own only where none is set and all tasks
    run on this machine."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """The same for a table that is costly to make: its rows are made once, not for the count and again for the files."""
    held = df.persist()
    try:
        return checkpoint(held)
    finally:
        held.unpersist()


def discard(df: DataFrame) -> None:
    """Removes a checkpoint's files before its table is forgotten; nothing may read it afterwards."""
    made = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if made.isDefined():
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(made.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
