"""Queries of vectors' quality: reduction and quantising, distribution measures, and the assessment of chunks with their texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prose as P
from ..functions import quality as Q
from ..functions import vectors as V
from .projection import read
from .prose import _KIND
from .registry import query, typed

_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"""WITH {_V}, m AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm, list_min(e) AS low, list_max(e) AS high, list_sort(list_transform(e, lambda x: abs(x))) AS sizes FROM v),
q AS (SELECT *, list_transform(e, lambda x: round((x - low) / (high - low) * 255) / 255 * (high - low) + low) AS quant, (sizes[len(sizes) - CAST(floor(len(sizes) * 0.8) AS INT)] + sizes[len(sizes) - CAST(floor(len(sizes) * 0.8) AS INT) + 1]) / 2 AS edge FROM m)
SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x / norm) * (x / norm))), 5) AS unit_square, round(sqrt(list_sum(list_transform(list_zip(e, quant), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 5) AS quantising_error, round(list_dot_product(e, quant), 4) AS quantised_dot,
  CAST(floor(len(e) * 0.8) AS BIGINT) AS reduced_to, round(list_sum(list_transform(list_filter(sizes, lambda x: x > edge), lambda x: x * x)) / (norm * norm), 5) AS energy_left, round(sizes[-1], 5) AS last_value FROM q""")
def vector_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit length, rounding to 8 bits and its error, and the share of the square sum that the largest four fifths keep."""
    v = F.col("embedding")
    rows = read(spark, sf_dir, "embeddings").select("vec_id", v, V.norm(v).alias("norm"), V.quantised(v).alias("q"), Q.reduced(v).alias("r"))
    five = lambda c, name: F.round(c, 5).alias(name)
    unit = V.unit(v)
    return rows.select(
        "vec_id", five(V.dot(unit, unit), "unit_square"), five(V.euclidean(v, F.col("q")), "quantising_error"), F.round(V.dot(v, F.col("q")), 4).alias("quantised_dot"),
        F.size("r").cast("long").alias("reduced_to"), five(V.dot(F.col("r"), F.col("r")) / (F.col("norm") * F.col("norm")), "energy_left"), five(F.abs(F.element_at("r", -1)), "last_value"))


@query(f"""WITH {_V}, b AS (SELECT vec_id, e, list_min(e) AS low, (list_max(e) - list_min(e)) / 50 AS width FROM v), c AS (SELECT vec_id, len(e) AS n, width, list_transform(e, lambda x: least(CAST(floor((x - low) / width) AS INT), 49)) AS place FROM b),
d AS (SELECT vec_id, n, width, unnest(place) AS p FROM c), h AS (SELECT vec_id, p, count(*) / (max(n) * max(width)) AS density FROM d GROUP BY 1, 2) SELECT vec_id, round(-sum(density * log2(density)), 4) AS entropy FROM h GROUP BY 1""")
def vector_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(Q.entropy(F.col("embedding")), 4).alias("entropy"))


_SYMBOLS = Q.MATH_SYMBOLS
_HAS = lambda *marks: "(" + " OR ".join(f"contains(low, '{m}')" for m in marks) + ")"
_MEAN = "list_avg(e)"
_QUALITY = f"""{_V}, t AS (SELECT doc_id, label, text, lower(text) AS low, e, {_KIND} AS kind, len(regexp_extract_all(text, '{P.WORD}')) AS n, doc_id % 5 <> 0 AS placed, (doc_id % 9 + 1) / 10 AS difficulty FROM v JOIN documents ON doc_id = vec_id WHERE text IS NOT NULL),
m AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm, list_sum(list_transform(e, lambda x: (x - {_MEAN}) * (x - {_MEAN}))) / len(e) AS variance, len(list_filter(e, lambda x: abs(x) > 0.000001)) / len(e) AS used, list_transform(e, lambda x: abs(x)) AS sizes FROM t),
g AS (SELECT *, sqrt(variance) AS spread, len(list_filter(sizes, lambda x: x > list_avg(sizes))) / len(e) AS above, least(1.0, len(list_filter(sizes, lambda x: x > list_aggregate(sizes, 'quantile_cont', 0.8))) / len(e) * 2) AS signal FROM m),
s AS (SELECT *, greatest(0.0, least(1.0, 0.8 - CASE WHEN norm < 0.5 THEN 0.2 WHEN norm > 2 THEN 0.1 ELSE 0 END - CASE WHEN spread < 0.1 THEN 0.3 WHEN spread > 1 THEN 0.1 ELSE 0 END - CASE WHEN n < 5 THEN 0.2 WHEN n > 500 THEN 0.1 ELSE 0 END)) AS semantic,
  greatest(0.0, least(1.0, 0.7 + CASE WHEN used > 0.8 THEN 0.2 WHEN used < 0.3 THEN -0.3 ELSE 0 END + CASE WHEN above BETWEEN 0.1 AND 0.4 THEN 0.1 ELSE 0 END)) AS usage,
  greatest(0.0, least(1.0, 0.7 + CASE kind WHEN 'definition' THEN CASE WHEN {_HAS('definition', 'define', 'is a', 'is defined as')} THEN 0.2 ELSE 0 END - CASE WHEN n < 10 THEN 0.1 ELSE 0 END WHEN 'example' THEN CASE WHEN {_HAS('example', 'exercise', 'problem', 'solution')} THEN 0.2 ELSE 0 END + CASE WHEN contains(low, 'solution') AND contains(low, 'example') THEN 0.1 ELSE 0 END
    WHEN 'math' THEN CASE WHEN regexp_matches(text, '[{_SYMBOLS}$=]') THEN 0.2 ELSE 0 END ELSE 0 END + CASE WHEN placed THEN 0.05 ELSE 0 END + 0.1 * greatest(0.0, least(1.0, 1 - abs(variance - (0.1 + difficulty * 0.2)) / (0.1 + difficulty * 0.2))))) AS teaching,
  CASE kind WHEN 'math' THEN greatest(0.0, least(1.0, 0.6 + CASE WHEN regexp_matches(text, '[{_SYMBOLS}]') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(text, '[$\\\\]') THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '=') AND regexp_matches(text, '[0-9]') THEN 0.1 ELSE 0 END + 0.1 * signal))
    WHEN 'definition' THEN greatest(0.0, least(1.0, 0.6 + CASE WHEN {_HAS('definition', 'define', 'is defined as', 'is a')} THEN 0.2 ELSE 0 END + CASE WHEN contains(text, '.') THEN 0.1 ELSE 0 END + CASE WHEN {_HAS('example', 'for instance', 'such as')} THEN 0.1 ELSE 0 END + CASE WHEN n > 15 THEN 0.1 WHEN n < 5 THEN -0.2 ELSE 0 END))
    WHEN 'example' THEN greatest(0.0, least(1.0, 0.6 + CASE WHEN {_HAS('example', 'exercise', 'problem')} THEN 0.2 ELSE 0 END + CASE WHEN {_HAS('solution', 'answer', 'result')} THEN 0.2 ELSE 0 END + CASE WHEN len(list_filter(string_split(text, '.'), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) > 2 THEN 0.1 ELSE 0 END
      + CASE WHEN {_HAS('example', 'exercise', 'problem')} AND {_HAS('solution', 'answer', 'result')} THEN 0.1 ELSE 0 END)) END AS own FROM g),
o AS (SELECT *, (semantic * 0.32 + usage * 0.27 + teaching * 0.21 + coalesce(own, 0) * 0.24) / (0.32 + 0.27 + 0.21 + CASE WHEN own IS NULL THEN 0 ELSE 0.24 END) AS overall FROM s)"""


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", P.kind_of_chunk(F.col("text")).alias("kind"))
    rows = docs.join(read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    v, k = F.col("embedding"), F.col("doc_id")
    sizes = F.transform(V.as_double(v), lambda x: F.abs(x))
    rows = rows.select("doc_id", "label", "text", "kind", Q.words(F.col("text")).alias("n"), V.norm(v).alias("norm"), V.central_moment(v, 2).alias("variance"), (F.size(F.filter(v, lambda x: F.abs(x) > 1e-6)) / F.size(v)).alias("used"), (F.size(F.filter(sizes, lambda x: x > V.mean(sizes))) / F.size(v)).alias("above"), Q.magnitude_signal(v).alias("signal"))
    t, kind, n = F.col("text"), F.col("kind"), F.col("n")
    fit = Q.difficulty_signal(F.col("variance"), (k % 9 + 1) / 10)
    rows = rows.withColumns({"semantic": Q.semantic(F.col("norm"), F.sqrt("variance"), n), "usage": Q.usage(F.col("used"), F.col("above")), "teaching": Q.teaching(t, kind, n, k % 5 != 0, fit), "own": Q.of_kind(t, kind, n, F.col("signal"))})
    return rows.withColumn("overall", Q.overall({"semantic": F.col("semantic"), "usage": F.col("usage"), "teaching": F.col("teaching"), "kind": F.col("own")}))


@query(typed(f"""WITH {_QUALITY} SELECT doc_id, kind, round(semantic, 5) AS semantic, round(usage, 5) AS usage, round(teaching, 5) AS teaching, round(own, 5) AS own, round(overall, 5) AS overall, CASE WHEN overall >= 0.9 THEN 'A' WHEN overall >= 0.8 THEN 'B' WHEN overall >= 0.7 THEN 'C' WHEN overall >= 0.6 THEN 'D' ELSE 'F' END AS grade,
  round(least(1.0, 0.7 + CASE WHEN regexp_matches(text, '[∫∑∂$=]') AND label % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN {_HAS('definition', 'example', 'exercise')} AND label % 3 = 0 THEN 0.2 ELSE 0 END)::DOUBLE, 4) AS model_fit FROM o""", semantic="DOUBLE", usage="DOUBLE"))
def chunk_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score of a chunk, the weighted whole, its grade, and how well the model (its label) suits the content."""
    rows, t = _assessed(spark, sf_dir), F.col("text")
    low = F.lower(t)
    fit = 0.7 + F.when(t.rlike("[∫∑∂$=]") & (F.col("label") % 2 == 0), 0.2).otherwise(0.0) + F.when((low.contains("definition") | low.contains("example") | low.contains("exercise")) & (F.col("label") % 3 == 0), 0.2).otherwise(0.0)
    five = [F.round(c, 5).alias(c) for c in ("semantic", "usage", "teaching", "own", "overall")]
    return rows.select("doc_id", "kind", *five, Q.grade(F.col("overall")).alias("grade"), F.round(F.least(F.lit(1.0), fit), 4).alias("model_fit"))


@query(f"""WITH {_QUALITY} SELECT label AS model, count(*) AS n, round(avg(overall), 5) AS mean, round(stddev_samp(overall), 4) AS spread, count(*) FILTER (overall >= 0.7) AS high_quality, count(*) FILTER (overall < 0.6) AS low_quality FROM o GROUP BY 1""")
def assessed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models by the quality of their vectors: how many are to be kept, how many to be made again."""
    o = F.col("overall")
    return _assessed(spark, sf_dir).groupBy(F.col("label").alias("model")).agg(F.count("*").alias("n"), F.round(F.avg(o), 5).alias("mean"), F.round(F.stddev_samp(o), 4).alias("spread"), F.count(F.when(o >= 0.7, 1)).alias("high_quality"), F.count(F.when(o < 0.6, 1)).alias("low_quality"))


@query(f"""WITH {_QUALITY}, a AS (SELECT label % 2 AS side, unnest(['semantic', 'usage', 'teaching', 'own']) AS metric, unnest([semantic, usage, teaching, own]) AS score FROM o), means AS (SELECT side, metric, avg(score) AS score FROM a WHERE score IS NOT NULL GROUP BY 1, 2)
SELECT x.metric, round(x.score, 5) AS first, round(y.score, 5) AS second, round(y.score - x.score, 5) AS difference FROM means x JOIN means y ON x.metric = y.metric AND x.side = 0 AND y.side = 1""")
def assessment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two assessments metric by metric."""
    metrics = ("semantic", "usage", "teaching", "own")
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in metrics))).alias("p")
    means = _assessed(spark, sf_dir).select((F.col("label") % 2).alias("side"), pairs).select("side", "p.metric", "p.score").groupBy("metric").pivot("side", [0, 1]).agg(F.avg("score"))
    return means.where("`0` IS NOT NULL AND `1` IS NOT NULL").select("metric", F.round("0", 5).alias("first"), F.round("1", 5).alias("second"), F.round(F.col("1") - F.col("0"), 5).alias("difference"))


@query(f"""WITH {_V}, d AS (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS dim FROM v), p AS (SELECT label, dim, var_pop(x) AS variance FROM d GROUP BY 1, 2), s AS (SELECT label, dim, sum(x / n) AS total FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS dim, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS n FROM v) GROUP BY 1, 2),
c AS (SELECT label, count(*) AS k FROM v GROUP BY 1), q AS (SELECT label, sum(total * total) AS square FROM s GROUP BY 1)
SELECT label, any_value(k) AS vectors, round(avg(variance), 6) AS mean_variance, round((any_value(square) - any_value(k)) / nullif(any_value(k) * (any_value(k) - 1), 0), 5) AS mean_similarity FROM p JOIN c USING (label) JOIN q USING (label) GROUP BY 1""")
def batch_vector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean variance of dimensions and mean similarity of all pairs, without pairs: the square of a sum of unit vectors holds them all."""
    rows = read(spark, sf_dir, "embeddings").select("label", F.posexplode(F.arrays_zip(V.as_double(F.col("embedding")).alias("x"), V.unit(F.col("embedding")).alias("u"))).alias("dim", "z"))
    dims = rows.groupBy("label", "dim").agg(F.count("*").alias("k"), F.var_pop("z.x").alias("variance"), F.sum("z.u").alias("total"))
    k = F.max("k")
    return dims.groupBy("label").agg(k.alias("vectors"), F.round(F.avg("variance"), 6).alias("mean_variance"), F.round(F.try_divide(F.sum(F.col("total") * F.col("total")) - k, k * (k - 1)), 5).alias("mean_similarity"))
