"""The queries of this subpackage: name -> f(spark, folder of tables), and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import op1_pieces, op2_jaccard, op3_quality, op4_repeats, op5_language, op6_katz, op7_embeddings, op8_cotraining, op9_packing, op10_licenses, op11_trie, op12_toxicity, op13_annulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and hash of the piece ids of all documents, and whether decoding gives each text back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = op1_pieces.model_path()
    rows = op1_pieces.decoded(op1_pieces.encoded(docs, path), path)
    same = F.coalesce("decoded", F.lit("")) == F.translate(F.coalesce("text", F.lit("")), op1_pieces.SPACE, " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), same.alias("round_trip"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return op2_jaccard.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and host verdicts for all documents."""
    return op3_quality.quality(table(spark, sf_dir, "documents")).drop("host", "host_rate")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without long repeats."""
    out = op4_repeats.without_repeats(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return out.select("doc_id", "n_bytes", F.col("n_removed").cast("long").alias("n_removed"), "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return op5_language.languages(docs).select("doc_id", "held_out", "lang_pred", "score")


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents."""
    return op6_katz.scored(table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return op7_embeddings.vector_components(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by co-trained views."""
    return op8_cotraining.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_packing_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of at most 4096 tokens."""
    return op9_packing.packed(table(spark, sf_dir, "documents"), op9_packing.tokenizer_path()).drop("padded")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in all documents."""
    return op10_licenses.licenses(table(spark, sf_dir, "documents")).drop("blocks")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return op11_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, and where the worst sentence of each begins."""
    out = op12_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumn("n_offending", F.size("offending").cast("long")).drop("offending")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors."""
    return op13_annulus.clustered(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_jaccard_join, op3_quality_rules, op4_suffix_dedup, op5_language_id, op6_katz_scores, op7_vector_dedup, op8_quality_classifier, op9_packing_pieces, op10_license_scan, op11_prefix_trie, op12_toxicity_scores, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": op3_quality.ORACLE, "op10_license_scan": op10_licenses.oracle_sql(), "op11_prefix_trie": op11_trie.ORACLE, "op13_centroid_clusters": op13_annulus.oracle_sql()}
