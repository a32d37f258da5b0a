"""Queries of vectors: measures, exact neighbours, search modes and their fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import neighbours, ranks, vector_index
from ..operators.lineage import cut, fresh_path
from .projection import read
from .registry import query

_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_SUM = lambda expression: f"list_sum(list_transform(e, lambda x: {expression}))"
_MOMENT = lambda k: f"list_sum(list_transform(e, lambda x: pow(x - list_avg(e), {k}))) / len(e)"


@query(f"""WITH {_V} SELECT vec_id, round(sqrt({_SUM('x * x')}), 5) AS norm, round({_MOMENT(3)} / pow({_MOMENT(2)}, 1.5), 4) AS skewness, round({_MOMENT(4)} / pow({_MOMENT(2)}, 2) - 3, 4) AS kurtosis,
  round(pow({_SUM('x * x')}, 2) / {_SUM('x * x * x * x')}, 4) AS dimensions, len(list_filter(e, lambda x: abs(x) > 0.000001)) AS used FROM v""")
def vector_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    second = vectors.central_moment(v, 2)
    return read(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(vectors.norm(v), 5).alias("norm"), F.round(vectors.central_moment(v, 3) / F.pow(second, 1.5), 4).alias("skewness"), F.round(vectors.central_moment(v, 4) / F.pow(second, F.lit(2)) - 3, 4).alias("kurtosis"),
        F.round(vectors.effective_dimensions(v), 4).alias("dimensions"), F.size(F.filter(v, lambda x: F.abs(x) > 1e-6)).cast("long").alias("used"))


_QUERY_SQL = f"WITH {_V}, q AS (SELECT e AS qe FROM v WHERE vec_id = 0), s AS (SELECT vec_id, label, round(list_cosine_similarity(e, qe), 6) AS score FROM v, q)"


def _query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One vector, which a search brings with it."""
    return read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


@query(f"{_QUERY_SQL} SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20")
def nearest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "vec_id", "embedding", 20)


@query(f"{_QUERY_SQL} SELECT vec_id, score FROM s WHERE label IN (1, 2, 3) AND score >= 0 ORDER BY score DESC, vec_id LIMIT 10")
def nearest_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "vec_id", "embedding", 10, 0.0, F.col("label").isin(1, 2, 3))


@query(f"""WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v JOIN v q ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s) WHERE place <= 5""")
def batch_nearest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return neighbours.batch_nearest(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)


@query(f"""{_QUERY_SQL}, own AS (SELECT label FROM v WHERE vec_id = 0), a AS (SELECT vec_id AS id, score FROM s ORDER BY score DESC, vec_id LIMIT 60),
b AS (SELECT a.id, least(1.0, a.score * CASE WHEN s.label = own.label THEN 1.3 ELSE 1.0 END) AS score FROM a JOIN s ON s.vec_id = a.id, own),
u AS (SELECT id, score * 0.4 AS ws, 0.4 AS w FROM a UNION ALL SELECT id, score * 0.2, 0.2 FROM b)
SELECT id, round(sum(ws) / sum(w) + 1e-12, 5) AS score, count(*) AS lists FROM u GROUP BY 1""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain similarity and similarity raised for the query's own concept, fused by their weights."""
    rows = read(spark, sf_dir, "embeddings")
    label = rows.where("vec_id = 0").select(F.col("label").alias("own")).limit(1)
    plain = neighbours.nearest(rows, _query_vector(spark, sf_dir), "vec_id", "embedding", 60)
    raised = plain.join(rows.select("vec_id", "label"), "vec_id").join(F.broadcast(label)).select("vec_id", F.least(F.lit(1.0), F.col("score") * F.when(F.col("label") == F.col("own"), 1.3).otherwise(1.0)).alias("score"))
    both = plain.select("vec_id", "score", F.lit(0.4).alias("w")).unionByName(raised.withColumn("w", F.lit(0.2)))
    return both.groupBy(F.col("vec_id").alias("id")).agg(F.round(F.sum(F.col("score") * F.col("w")) / F.sum("w") + 1e-12, 5).alias("score"), F.count("*").alias("lists"))


@query("SELECT label, dim, round(avg(x), 5) AS mean, count(*) AS vectors FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY 1, 2")
def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", F.posexplode(vectors.as_double(F.col("embedding"))).alias("dim", "x"))
    return rows.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 5).alias("mean"), F.count("*").alias("vectors"))


@query(f"WITH {_V}, n AS (SELECT label, sqrt({_SUM('x * x')}) AS n FROM v) SELECT label, count(*) AS vectors, round(avg(n), 5) AS mean, round(stddev_pop(n), 5) AS spread, round(min(n), 5) AS least, round(max(n), 5) AS most, round(quantile_cont(n, 0.9), 5) AS p90 FROM n GROUP BY 1")
def norm_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("label", vectors.norm(F.col("embedding")).alias("n"))
    five = lambda c, name: F.round(c, 5).alias(name)
    plain = rows.groupBy("label").agg(F.count("*").alias("vectors"), five(F.avg("n"), "mean"), five(F.stddev_pop("n"), "spread"), five(F.min("n"), "least"), five(F.max("n"), "most"))
    return plain.join(ranks.percentiles(rows, "n", {"p90": 0.9}, "label"), "label").withColumn("p90", F.round("p90", 5))


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, vector_index.Index]:
    rows = read(spark, sf_dir, "embeddings")
    return rows, vector_index.build(rows, "vec_id", "embedding", fresh_path(spark, "vector-index"))


@query()
def ivf_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of each vector whose number is divisible by 100 among the probed lists of an index of all vectors, with the recall of all answers."""
    rows, index = _indexed(spark, sf_dir)
    queries = rows.where("vec_id % 100 = 0")
    found = cut(vector_index.search(index, queries, "vec_id", "embedding", 10))
    share = vector_index.recall(found, neighbours.batch_nearest(rows, queries, "vec_id", "embedding", 10)).select("recall")
    return found.join(F.broadcast(share))  # one row


@query("SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, count(*) FILTER (vec_id % 100 = 0) * least(10, count(*) - 1) AS neighbours, true AS enough FROM embeddings")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index finds nine tenths of the exact ten nearest."""
    rows, index = _indexed(spark, sf_dir)
    queries = rows.where("vec_id % 100 = 0")
    found = vector_index.search(index, queries, "vec_id", "embedding", 10)
    return vector_index.recall(found, neighbours.batch_nearest(rows, queries, "vec_id", "embedding", 10)).select("queries", "neighbours", (F.col("recall") >= 0.9).alias("enough"))


@query("SELECT count(*) AS rows, true AS whole FROM embeddings WHERE embedding IS NOT NULL")
def vector_index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the files of an index, and whether they are those of its lists."""
    _, index = _indexed(spark, sf_dir)
    lists = vector_index.status(spark, index)
    return lists.agg(F.sum("rows").alias("rows"), ((F.count("*") == len(index.sizes)) & (F.sum("rows") == sum(index.sizes.values()))).alias("whole"))
