"""A pipeline of the training-data operators over the documents table: quality, exact and near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlake.llm import exact_dedup, line_quality, packing, personal_data, simhash
from skeinlake.llm.common import stage, table
from skeinlake.session import ship


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars of texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without their boilerplate lines."""
    ship(spark)
    return _sized(line_quality.keep_good(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship(spark)
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of near fingerprints connect."""
    ship(spark)
    return simhash.deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by the name of its kind."""
    ship(spark)
    return _sized(personal_data.find(docs, personal_data.train(docs), redact=True))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, each with its sequence and place there."""
    import public_tokenizers

    ship(spark)
    return packing.pack(packing.cut_into_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("personal data", private),
    ("packing", sequences),
]

#: Training, tokens and fingerprints are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
