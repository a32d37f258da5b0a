"""Queries of the embedding pipeline, and of chunks of growing documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embedding as E
from ..operators import chunking
from ..operators import embedding as pipeline
from ..operators.lineage import fresh_path
from . import chunking as chunk_plans
from .projection import read
from .registry import query, registered_sql


@query("""WITH w AS (SELECT doc_id, list_transform(range(4), lambda k: CAST('0x' || substr(md5(text), 1 + 8 * k, 8) AS BIGINT) / 4294967296 * 2 - 1) AS w, greatest(1, floor(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) * 1.3)) AS tokens FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 1536 AS dimensions, round(w[1], 6) AS first, round(w[4], 6) AS last, round(384 * list_sum(w), 4) AS total, CAST(tokens AS BIGINT) AS tokens FROM w""")
def hash_tiled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of 1,536 numbers that tile the words of a text's digest."""
    v = F.col("v")
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", E.hash_tiled(F.col("text")).alias("v"), E.tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", F.size(v).alias("dimensions"), F.round(v[0], 6).alias("first"), F.round(v[1535], 6).alias("last"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), "tokens")


def _paragraphs(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", "([.!?]) ([A-Z])", "$1\n\n$2").alias("text"))


def _piped(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunks(_paragraphs(read(spark, sf_dir, "documents")), ["doc_id"], "text", chunking.greedy)
    return pipeline.assessed(E.with_vectors(chunks, ["doc_id", "chunk_no"], "chunk"))


@query()
def mock_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded vectors of all documents, the same at each run."""
    rows = E.with_vectors(read(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text")
    return rows.select("doc_id", E.tokens(F.col("text")).alias("tokens"), "vector")


@query()
def embedding_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into chunks, embedded, assessed and filtered in one plan: what became of each."""
    return pipeline.by_document(_piped(spark, sf_dir))


@query(f"SELECT doc_id, count(*) AS chunks, count(*) AS embedded, CAST(0 AS BIGINT) AS failed, CAST(sum(characters) AS BIGINT) AS characters FROM ({registered_sql('greedy_chunks')}) GROUP BY 1")
def embedding_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each document by outcome."""
    rows = _piped(spark, sf_dir)
    failed = F.count(F.when(F.col("outcome") == "failed", 1))
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count("vector").alias("embedded"), failed.alias("failed"), F.sum(F.length("chunk").cast("long")).alias("characters"))


@query(registered_sql("greedy_chunks"))
def growing_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in parts of 700 characters, in several batches and out of order: the chunks of the whole texts."""
    from ..streaming import chunks

    # A text is cut up in one pass and does not go with its parts; no text is empty here, and an inner explode would cut up each once more to see that.
    texts = _paragraphs(read(spark, sf_dir, "documents").where("text <> ''"))
    rows = texts.select("doc_id", F.regexp_extract_all("text", F.lit("(?s).{1,700}"), F.lit(0)).alias("parts")).withColumn("n", F.size("parts"))
    rows = rows.select("doc_id", "n", F.posexplode_outer("parts").alias("part_no", "part"))
    parts = rows.select("doc_id", F.col("part_no").cast("long"), "part", (F.col("part_no") == F.col("n") - 1).alias("last"))
    path = fresh_path(spark, "parts")
    parts.repartition(max(4, spark.sparkContext.defaultParallelism), "doc_id", "part_no").write.parquet(path)
    files = len(spark.read.schema(parts.schema).parquet(path).inputFiles())
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", -(-files // 4)).parquet(path)
    return chunk_plans._rows(chunks.growing_chunks(stream), "doc_id")
