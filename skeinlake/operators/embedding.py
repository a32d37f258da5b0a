"""The embedding pipeline: chunks of documents, a vector for each, its assessment, and what is kept of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prose as P
from ..functions import quality as Q
from ..functions import vectors as V
from ..functions.embedding import tokens

#: A chunk whose vector scores less is not kept.
LEAST = 0.6


def assessed(chunks: DataFrame) -> DataFrame:
    """Adds quality, grade and outcome (kept, filtered, failed) to chunks (doc_id, chunk_no, chunk, vector).  Without a vector a chunk has failed."""
    v, t = F.col("vector"), F.col("chunk")
    sizes = F.transform(V.as_double(v), lambda x: F.abs(x))
    rows = chunks.withColumns({"kind": P.kind_of_chunk(t), "n": Q.words(t), "variance": V.central_moment(v, 2)})
    n, kind = F.col("n"), F.col("kind")
    used, above = F.size(F.filter(v, lambda x: F.abs(x) > 1e-6)) / F.size(v), F.size(F.filter(sizes, lambda x: x > V.mean(sizes))) / F.size(v)
    scores = {"semantic": Q.semantic(V.norm(v), F.sqrt("variance"), n), "usage": Q.usage(used, above), "teaching": Q.teaching(t, kind, n, F.lit(True), Q.difficulty_signal(F.col("variance"), F.lit(0.5))), "kind": Q.of_kind(t, kind, n, Q.magnitude_signal(v))}
    rows = rows.withColumn("quality", F.when(v.isNotNull(), Q.overall(scores)))
    outcome = F.when(v.isNull(), "failed").when(F.col("quality") < LEAST, "filtered").otherwise("kept")
    return rows.withColumns({"grade": F.when(v.isNotNull(), Q.grade(F.col("quality"))), "outcome": outcome}).drop("n", "variance")


def by_document(rows: DataFrame) -> DataFrame:
    """A row for each document: chunks, embedded, failed, filtered, kept, tokens of what is kept, mean quality, and chunks by grade."""
    is_ = lambda name: F.count(F.when(F.col("outcome") == name, 1))
    grades = F.array(*(F.concat(F.lit(f"{g}:"), F.count(F.when(F.col("grade") == g, 1)).cast("string")) for g in "ABCDF"))
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.count("vector").alias("embedded"), is_("failed").alias("failed"), is_("filtered").alias("filtered"), is_("kept").alias("kept"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "kept", tokens(F.col("chunk")))), F.lit(0)).alias("tokens"), F.round(F.avg("quality"), 5).alias("mean_quality"), F.array_join(grades, ",").alias("grades"))
