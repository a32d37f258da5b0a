"""Queries that join by ranges: points in intervals, intervals in intervals, substrings, pairs above a similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import intervals, names
from ..operators.lineage import cut
from .projection import read
from .registry import query, typed


def _stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of days: from an order to the last shipping of its lines."""
    last = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("until"))
    rows = read(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    day = lambda c: F.datediff(F.col(c), F.lit("1992-01-01")).cast("long")
    return rows.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 40).alias("book"), F.least(day("o_orderdate"), day("until")).alias("begin"), (F.greatest(day("o_orderdate"), day("until")) + 1).alias("finish"))


_STAYS_SQL = """u AS (SELECT l_orderkey, max(l_shipdate) AS until FROM lineitem GROUP BY 1), i0 AS (SELECT o_orderkey AS id, o_custkey % 40 AS book, datediff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS a, datediff('day', DATE '1992-01-01', CAST(until AS DATE)) AS b FROM orders JOIN u ON l_orderkey = o_orderkey),
i AS (SELECT id, book, least(a, b) AS "begin", greatest(a, b) + 1 AS finish FROM i0)"""


@query(f"""WITH {_STAYS_SQL}, p AS (SELECT event_id, user_id % 40 AS book, event_id % 2500 AS pos FROM events) SELECT event_id, count(*) AS intervals, min(id) AS first_id FROM p JOIN i ON i.book = p.book AND pos >= "begin" AND pos < finish GROUP BY 1""")
def points_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points meet the pieces of intervals in their bucket, each with its number of intervals."""
    points = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("book"), (F.col("event_id") % 2500).alias("at"))
    found = points.join(intervals.covering(_stays(spark, sf_dir), points, "book", 32, "id"), ["book", "at"])
    return found.groupBy("event_id").agg(F.sum("intervals").alias("intervals"), F.min("first").alias("first_id"))


@query(f"""WITH {_STAYS_SQL} SELECT a.id, count(*) AS inside FROM i a JOIN i b ON a.book = b.book AND b.id <> a.id AND b."begin" >= a."begin" AND b.finish <= a.finish GROUP BY 1""")
def intervals_in_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment, counted in buckets of begins; intervals of the same number, itself among them, are taken off."""
    rows = cut(_stays(spark, sf_dir))
    found = rows.join(intervals.containing(rows, rows, "book", 64), ["book", "begin", "finish"]).groupBy("id").agg(F.sum("inside").alias("all"))
    same = rows.alias("a").join(rows.alias("b"), ["id", "book"]).where("b.begin >= a.begin AND b.finish <= a.finish").groupBy("id").agg(F.count("*").alias("own"))
    return found.join(same, "id").select("id", (F.col("all") - F.col("own")).alias("inside")).where("inside > 0")


@query(typed(f"""WITH {_STAYS_SQL}, o AS (SELECT *, coalesce(max(finish) OVER (PARTITION BY book ORDER BY "begin", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -100) AS before FROM i WHERE id % 60 = 0), g AS (SELECT *, sum(CAST("begin" > before + 2 AS INT)) OVER (PARTITION BY book ORDER BY "begin", id) AS island FROM o)
SELECT book, island, min("begin") AS "begin", max(finish) AS finish, count(*) AS regions FROM g GROUP BY 1, 2""", island="BIGINT"))
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of a book with a gap of at most two joined to one."""
    return intervals.merged(_stays(spark, sf_dir).where("id % 60 = 0"), "book", 2)


@query("""WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS name FROM part) SELECT name, count(*) AS pages, min(page_id) AS first_page FROM pages JOIN w ON contains(lower(html), lower(name)) GROUP BY 1""")
def names_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring join: automata of all names read each text once."""
    wanted = read(spark, sf_dir, "part").select(F.split("p_name", " ")[0].alias("name")).distinct()
    found = names.names_in(read(spark, sf_dir, "pages"), "page_id", "html", wanted)
    return found.groupBy("name").agg(F.count("*").alias("pages"), F.min("id").alias("first_page"))


@query("""WITH c AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part), t AS (SELECT DISTINCT split_part(text, ' ', 1) AS name FROM documents), n AS (SELECT name FROM c UNION SELECT name FROM t),
d AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL) SELECT doc_id, count(*) AS names, max(length(name)) AS longest FROM d JOIN (SELECT name FROM n WHERE name <> '' AND name IS NOT NULL) ON contains(low, lower(name)) GROUP BY 1""")
def names_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the catalogue and first words of all documents, in all documents: names that hold each other are all found."""
    part, docs = read(spark, sf_dir, "part"), read(spark, sf_dir, "documents")
    wanted = part.select(F.col("p_name").alias("name")).unionByName(part.select(F.get(F.split("p_name", " "), F.lit(1)).alias("name"))).unionByName(docs.select(F.split("text", " ", 2)[0].alias("name"))).distinct()
    return names.names_in(docs, "doc_id", "text", wanted).groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("names"), F.max(F.length("name")).cast("long").alias("longest"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 5) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id % 100 = 0 AND a.vec_id < b.vec_id""")
def sample_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a sample of vectors: the sample is the feature, and bounds the pairs."""
    rows = read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding")
    a, b = rows.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), rows.select(F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(vectors.cosine(F.col("x"), F.col("y")), 5).alias("score"))


@query("""SELECT p_partkey AS concept, p.p_name AS name, a.p_name AS requires, b.p_name AS also_requires FROM part p LEFT JOIN (SELECT p_partkey AS k, p_name FROM part) a ON a.k = p_partkey // 2 AND p_partkey >= 2 LEFT JOIN (SELECT p_partkey AS k, p_name FROM part) b ON b.k = p_partkey // 3 AND p_size % 3 = 0""")
def concepts_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept and the names of its prerequisites: the same table joined twice."""
    parts = read(spark, sf_dir, "part")
    name = lambda alias, key: parts.select(F.col("p_partkey").alias(key), F.col("p_name").alias(alias))
    rows = parts.select("p_partkey", "p_name", F.when(F.col("p_partkey") >= 2, F.floor(F.col("p_partkey") / 2)).alias("a"), F.when(F.col("p_size") % 3 == 0, F.floor(F.col("p_partkey") / 3)).alias("b"))
    return rows.join(name("requires", "a"), "a", "left").join(name("also_requires", "b"), "b", "left").select(F.col("p_partkey").alias("concept"), F.col("p_name").alias("name"), "requires", "also_requires")
