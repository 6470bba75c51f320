"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, langid, license, mixing, pieces, pii, quality, simhash, toxicity, vectors
from .common import table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """The place of a public tokenizer file: in the folder that PANELSPARK_TOKENIZERS names, else where the installed
    package of public tokenizers has it."""
    folder = os.environ.get("PANELSPARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.digests(table(spark, sf_dir, "documents"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokens(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "mix_epoch", "mix_key", "mix_weight")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_langid, op3_quality, op4_vectors, op5_fingerprint, op6_license, op7_pieces, op8_toxicity, op9_mixing, op10_pii)}
#: The others are hash sketches, trained models or parsers: the tests in tests/llm hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_vectors": """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), usable AS MATERIALIZED (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.98 ELSE false END
), reach AS (
  SELECT a AS node, a AS low FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.low = l.a
), parts AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
degrees AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, coalesce(p.component_id, v.vec_id) AS component_id,
  coalesce(coalesce(p.component_id, v.vec_id) = v.vec_id, true) AS kept
FROM v LEFT JOIN parts p ON v.vec_id = p.node LEFT JOIN degrees d ON v.vec_id = d.node""",
}
