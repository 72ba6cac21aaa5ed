"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents, with the values of rows that stay but
where a stage changes texts. All take null and empty texts, repeated rows and
empty tables, and pass columns of any other name through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import op2_jaccard, op3_quality, op4_repeats, op5_language, op9_packing
from corpusloom.llm.common import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; null texts and those without a letter go, repeated rows stay each."""
    return op5_language.language_kept(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host isn't rejected; null and empty texts fail, repeated rows count each."""
    return op3_quality.quality_kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group of near duplicates; of rows equal in doc_id and text one stays."""
    return op2_jaccard.near_duplicates_removed(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without long strings that stand elsewhere too; a null text stays null."""
    return op4_repeats.stripped(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token sequences of at most 4096; a null or empty text is its end alone."""
    return op9_packing.packed(docs, op9_packing.tokenizer_path())


STAGES = [("language", language), ("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packing)]

#: Shingle sets, suffix arrays and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
