"""Cleans documents for training in five stages, each an operator of panelspark.llm."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import mixing, pieces, pii, quality, simhash
from panelspark.llm.common import checkpoint, checkpoint_folder, table
from panelspark.llm.components import connected_components
from panelspark.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality ranking rejects. It learns from the labels of ``sf_dir`` that lie outside the
    held-out part; a document without text has no words to keep and is scored like any other."""
    model = quality.fit(docs, quality.training_rows(table(spark, sf_dir, "labels")))
    return docs.where(quality.score_column(model) >= quality.CUT)


def by_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, h1, h2, group) of every row by the fingerprints of op1's contract: four words, four of 64 bits."""
    rows = docs.select(F.struct(*simhash.identity(docs)).alias("doc_id"), "text")
    prints = checkpoint(simhash.fingerprints(rows).select("doc_id.*", "fingerprint"))
    classes = checkpoint(prints.select("fingerprint", F.col("fingerprint").alias("rep")).distinct())
    parts = connected_components(simhash.near_links(classes)).select(F.col("node").alias("fingerprint"), "component")
    return prints.join(parts, "fingerprint", "left").select("doc_id", "h1", "h2", F.coalesce("component", "fingerprint").alias("group"))


def one_row_of_each(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of each group that ``rows`` name: that of smallest doc_id, rows without one last, then by hashes of the
    text. Of rows alike in id and text one is kept. Only ids and hashes are shuffled with the groups; texts meet the
    decision once."""
    rows = checkpoint(rows)
    key = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "h1", "h2")
    kept = checkpoint(rows.groupBy("group").agg(F.min(key).alias("k")).select("k.doc_id", "k.h1", "k.h2"))
    repeats = rows.join(kept, simhash.same(rows, kept), "left_semi").groupBy("doc_id", "h1", "h2").count().where("count > 1").limit(1).count()
    # names that no column of the input can have by chance
    mine = [c.alias(f"__{name}") for c, name in zip(simhash.identity(docs), ("id", "h1", "h2"), strict=True)]
    marked = docs.select("*", *mine)
    met = marked["__h1"].eqNullSafe(kept["h1"]) & marked["__h2"].eqNullSafe(kept["h2"]) & marked["__id"].eqNullSafe(kept["doc_id"])
    out = marked.join(kept, met, "left_semi")
    out = out.dropDuplicates(["__id", "__h1", "__h2"]) if repeats else out
    return out.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts that links join; two texts are linked from 0.8 of their different
    five-word shingles in common."""
    return one_row_of_each(docs, simhash.near_copies(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same decision on groups by op1's fingerprints, which link far fewer near copies; not a stage."""
    return one_row_of_each(docs, by_fingerprint(docs))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind and counts the characters anew."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources towards even weights; every document is read once at least."""
    return mixing.mix(docs, facts=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the number and digests of its ids, one row for each time that the mixture reads it."""
    return pieces.tokens(docs, tokenizer_path())


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_near_copies), ("personal_data", hide_personal_data), ("mixing", mix_sources), ("encoding", encode)]


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder through the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each stage's rows are written to the shared folder and read again.
    The rows of a stage are removed when those of the next are written; the last ones stay, as the result reads them."""
    docs, before = table(spark, sf_dir, "documents"), None
    home = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{home}/{name}"
    return docs


QUERIES = {"pipeline": run}
#: Trained scores, fingerprints and merges are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None
ORACLES: dict[str, str] = {}
