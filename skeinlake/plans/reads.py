"""Smaller reads and writes of the platform: paths and their concepts, books and chunks, questions, enrolments, exports of progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import upserts
from .learners import _LATEST_SQL, _latest
from .projection import LEARNER_EVENTS_SQL, learner_events, read
from .registry import query, typed

_MENTIONS_SQL = "m AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS concept FROM lineitem)"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("concept")).distinct()


@query("""SELECT p_brand AS path, count(*) AS concepts, max(p_partkey) AS newest, round(avg(p_size), 4) AS mean_size FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY newest DESC LIMIT 15""")
def path_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").where("p_size > 10").groupBy(F.col("p_brand").alias("path")).agg(F.count("*").alias("concepts"), F.max("p_partkey").alias("newest"), F.round(F.avg("p_size"), 4).alias("mean_size"))
    return rows.orderBy(F.desc("newest")).limit(15)


@query("""SELECT a.p_partkey AS concept, a.p_name AS name, row_number() OVER (PARTITION BY a.p_brand ORDER BY a.p_partkey) AS place, list_aggregate(list_sort(list(DISTINCT b.p_name) FILTER (b.p_name IS NOT NULL)), 'string_agg', ',') AS prerequisites FROM part a LEFT JOIN part b ON b.p_partkey IN (a.p_partkey // 2, a.p_partkey // 3) AND b.p_partkey <> a.p_partkey WHERE a.p_brand = 'Brand#7' GROUP BY a.p_partkey, a.p_name, a.p_brand""")
def path_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concepts of one path in order, each with the names of what it requires."""
    parts = read(spark, sf_dir, "part")
    own = parts.where("p_brand = 'Brand#7'").select(F.col("p_partkey").alias("concept"), F.col("p_name").alias("name"))
    k = F.col("concept")
    needs = own.select("concept", F.explode(F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3)))).alias("p_partkey")).where("p_partkey <> concept").join(parts.select("p_partkey", "p_name"), "p_partkey")
    names = needs.groupBy("concept").agg(F.array_join(F.array_sort(F.collect_set("p_name")), ",").alias("prerequisites"))
    place = F.row_number().over(Window.orderBy("concept")).cast("long")  # one path
    return own.withColumn("place", place).join(names, "concept", "left").select("concept", "name", "place", "prerequisites")


@query("""SELECT p_partkey AS concept, p_name AS name, p_type AS kind, n AS chunks, coalesce('Q: ' || nullif(CASE WHEN p_size % 2 = 0 THEN p_type END, ''), 'to be generated') AS question FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_partkey BETWEEN 10 AND 60""")
def concept_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts by key with their number of chunks and the stored question, or word that it is to be made."""
    parts = read(spark, sf_dir, "part").where("p_partkey BETWEEN 10 AND 60")
    chunks = _mentions(spark, sf_dir).groupBy(F.col("concept").alias("p_partkey")).agg(F.count("*").alias("chunks"))
    stored = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Q: "), "p_type"))
    return parts.join(chunks, "p_partkey", "left").select(F.col("p_partkey").alias("concept"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), "chunks", F.coalesce(stored, F.lit("to be generated")).alias("question"))


@query(typed("""SELECT source AS book, count(*) AS chunks, sum(n_chars) AS characters, min(lang) AS first_language FROM documents WHERE source IS NOT NULL AND lang = 'en' GROUP BY 1 ORDER BY book LIMIT 10 OFFSET 5""", characters="BIGINT"))
def book_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the books of one subject."""
    rows = read(spark, sf_dir, "documents").where("source IS NOT NULL AND lang = 'en'").groupBy(F.col("source").alias("book")).agg(F.count("*").alias("chunks"), F.sum("n_chars").alias("characters"), F.min("lang").alias("first_language"))
    return rows.orderBy("book").offset(5).limit(10)


@query(f"""WITH {_MENTIONS_SQL}, c AS (SELECT chunk, string_agg(concept, ',' ORDER BY concept) AS concepts FROM m GROUP BY 1) SELECT d.doc_id AS chunk, source AS book, lang, quality, label, coalesce(concepts, '') AS concepts FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings ON vec_id = d.doc_id LEFT JOIN c ON c.chunk = d.doc_id""")
def content_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk with all that may be known of it: four outer joins on its key."""
    concepts = _mentions(spark, sf_dir).groupBy(F.col("chunk").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("concept")), lambda c: c.cast("string")), ",").alias("concepts"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book"), "lang").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    rows = rows.join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left").join(concepts, "doc_id", "left")
    return rows.select(F.col("doc_id").alias("chunk"), "book", "lang", "quality", "label", F.coalesce("concepts", F.lit("")).alias("concepts"))


@query(f"""WITH {LEARNER_EVENTS_SQL}, a AS (SELECT max(ts) AS as_of FROM learner_events), r AS (SELECT student_id, concept_id, max(ts) AS last FROM learner_events, a WHERE ts > as_of - INTERVAL 7 DAY GROUP BY 1, 2)
SELECT student_id, concept_id, last FROM (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY last DESC, concept_id) AS place FROM r) WHERE place <= 10""")
def current_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each learner has studied in the last seven days, the newest ten."""
    events = learner_events(spark, sf_dir)
    as_of = F.broadcast(events.agg(F.max("ts").alias("as_of")))  # one row
    last = events.join(as_of).where(F.col("ts") > F.col("as_of") - F.expr("INTERVAL 7 DAYS")).groupBy("student_id", "concept_id").agg(F.max("ts").alias("last"))
    place = F.row_number().over(Window.partitionBy("student_id").orderBy(F.desc("last"), "concept_id"))
    return last.withColumn("place", place).where("place <= 10").drop("place")


@query(f"""WITH {_MENTIONS_SQL}, b AS (SELECT DISTINCT concept, source AS book FROM m JOIN documents ON doc_id = chunk WHERE source IS NOT NULL) SELECT book, concept, place FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY concept) AS place FROM b) WHERE place <= 20""")
def book_main_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _mentions(spark, sf_dir).join(read(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("doc_id").alias("chunk"), F.col("source").alias("book")), "chunk").select("book", "concept").distinct()
    place = F.row_number().over(Window.partitionBy("book").orderBy("concept"))
    return rows.withColumn("place", place.cast("long")).where("place <= 20")


@query(f"""WITH {_MENTIONS_SQL}, s AS (SELECT chunk, max(concept) AS stored FROM m WHERE concept % 4 = 0 GROUP BY 1), g AS (SELECT chunk, min(concept) AS found FROM m GROUP BY 1) SELECT g.chunk, coalesce(stored, found) AS concept, CASE WHEN stored IS NULL THEN 'graph' ELSE 'table' END AS origin FROM g LEFT JOIN s ON s.chunk = g.chunk""")
def chunk_concept_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's concept from the table, else from the graph: one aggregation gives both."""
    k = F.col("concept")
    rows = _mentions(spark, sf_dir).groupBy("chunk").agg(F.max(F.when(k % 4 == 0, k)).alias("stored"), F.min("concept").alias("found"))
    return rows.select("chunk", F.coalesce("stored", "found").alias("concept"), F.when(F.col("stored").isNull(), "graph").otherwise("table").alias("origin"))


@query("""SELECT doc_id AS chunk, unnest(range(1, 4)) AS question_no, 'What about ' || left(text, 12) || '? (' || unnest(range(1, 4)) || ')' AS question FROM documents WHERE text IS NOT NULL""")
def chunk_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions for each chunk, made by expanding a sequence."""
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("chunk"), F.left("text", F.lit(12)).alias("t"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("question_no"))
    return rows.select("chunk", "question_no", F.concat(F.lit("What about "), "t", F.lit("? ("), F.col("question_no").cast("string"), F.lit(")")).alias("question"))


@query(f"""{_LATEST_SQL}, e AS (SELECT c_custkey AS learner, c_custkey % 100 AS course FROM customer), w AS (SELECT student_id, concept_id, score, status FROM latest WHERE EXISTS (SELECT 1 FROM e WHERE learner = student_id AND course % 2 = concept_id % 2))
SELECT student_id, concept_id, CASE WHEN score >= 0.8 THEN 'completed' ELSE status END AS status, CASE status WHEN 'mastered' THEN 100 WHEN 'completed' THEN 50 WHEN 'in_progress' THEN 30 ELSE 10 END AS points FROM w""")
def progress_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress rows that their owners may write, with the status that follows from the score, and the points of the event."""
    owners = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("student_id"), (F.col("c_custkey") % 100 % 2).alias("half")).distinct()
    rows = _latest(spark, sf_dir).withColumn("half", F.col("concept_id") % 2).join(owners, ["student_id", "half"], "left_semi")
    status = F.col("status")
    points = F.when(status == "mastered", 100).when(status == "completed", 50).when(status == "in_progress", 30).otherwise(10)
    return rows.select("student_id", "concept_id", F.when(F.col("score") >= 0.8, "completed").otherwise(status).alias("status"), points.alias("points"))


@query("""WITH old AS (SELECT o_custkey AS learner, o_orderkey % 50 AS course FROM orders WHERE o_orderstatus = 'F'), new AS (SELECT o_custkey AS learner, o_orderkey % 50 AS course FROM orders WHERE o_orderstatus = 'O') SELECT DISTINCT learner, course, 'kept' AS state FROM old UNION ALL SELECT DISTINCT learner, course, 'added' FROM new n WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.learner = n.learner AND old.course = n.course)""")
def enrolments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enrolments with new ones, each pair of learner and course once."""
    pairs = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("learner"), (F.col("o_orderkey") % 50).alias("course"), "o_orderstatus")
    old = pairs.where("o_orderstatus = 'F'").select("learner", "course").distinct().withColumn("state", F.lit("kept"))
    new = pairs.where("o_orderstatus = 'O'").select("learner", "course").distinct().withColumn("state", F.lit("added"))
    return upserts.insert_ignore(old, new, ["learner", "course"])


@query(f"""{_LATEST_SQL} SELECT student_id, c_name AS name, n_name AS milestone, concept_id, status, round(score, 4) AS score, '{{"k":' || concept_id || ',"status":"' || status || '"}}' AS details FROM latest JOIN customer ON c_custkey = student_id JOIN nation ON n_nationkey = c_nationkey""")
def progress_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress with the names of learners and milestones, and the details as JSON."""
    people = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("student_id"), F.col("c_name").alias("name"), F.col("n_name").alias("milestone"))
    details = F.to_json(F.struct(F.col("concept_id").alias("k"), "status"))
    return _latest(spark, sf_dir).join(people, "student_id").select("student_id", "name", "milestone", "concept_id", "status", F.round("score", 4).alias("score"), details.alias("details"))


@query("""WITH h AS (SELECT user_id AS student_id, event_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS concept, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) SELECT student_id, event_id, concept, round(value / 100, 4) AS score, place, CASE WHEN value >= 80 THEN 'right' WHEN value >= 50 THEN 'partly' ELSE 'wrong' END AS verdict FROM h WHERE place <= 20""")
def evaluation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty evaluations of each learner, with the concept from their JSON notes."""
    note = F.from_json("props", "k INT", {"mode": "PERMISSIVE"})["k"]
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long")
    rows = read(spark, sf_dir, "events").withColumn("place", place).where("place <= 20")
    verdict = F.when(F.col("value") >= 80, "right").when(F.col("value") >= 50, "partly").otherwise("wrong")
    return rows.select(F.col("user_id").alias("student_id"), "event_id", note.alias("concept"), F.round(F.col("value") / 100, 4).alias("score"), "place", verdict.alias("verdict"))


@query("""SELECT user_id AS student_id, count(*) AS answers, round(avg(CASE WHEN value >= 60 THEN 1.0 ELSE 0.0 END), 6) AS score, count(*) FILTER (try_cast(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE) IS NULL) AS failed FROM events GROUP BY 1""")
def practice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of right answers, and how many inputs of a batch cannot be evaluated."""
    given = F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("student_id")).agg(F.count("*").alias("answers"), F.round(F.avg(F.when(F.col("value") >= 60, 1.0).otherwise(0.0)), 6).alias("score"), F.count(F.when(given.try_cast("double").isNull(), 1)).alias("failed"))


@query("""SELECT c_custkey AS learner, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'balance is negative' END, CASE WHEN length(c_mktsegment) > 9 THEN 'segment is too long' END, CASE WHEN c_name IS NULL OR c_name = '' THEN 'name is required' END, CASE WHEN c_nationkey % 5 = 0 THEN 'nation is not open' END) AS reasons FROM customer""")
def input_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reasons why a row is not accepted, none for those that are."""
    reasons = F.concat_ws(",", F.when(F.col("c_acctbal") < 0, "balance is negative"), F.when(F.length("c_mktsegment") > 9, "segment is too long"), F.when(F.coalesce("c_name", F.lit("")) == "", "name is required"), F.when(F.col("c_nationkey") % 5 == 0, "nation is not open"))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("learner"), reasons.alias("reasons"))


@query("""SELECT c_custkey AS learner, p.path, p.status, p.concepts FROM customer LEFT JOIN (SELECT o_custkey, o_orderpriority AS path, max(o_orderstatus) AS status, count(*) AS concepts FROM orders GROUP BY 1, 2) p ON o_custkey = c_custkey AND p.status <> 'F'""")
def learner_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of learners with their status, learners without an open one included."""
    paths = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("learner"), F.col("o_orderpriority").alias("path")).agg(F.max("o_orderstatus").alias("status"), F.count("*").alias("concepts")).where("status <> 'F'")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("learner")).join(paths, "learner", "left").select("learner", "path", "status", "concepts")


@query("""SELECT o_orderpriority AS path, count(*) AS tickets, count(*) FILTER (o_orderstatus = 'F') AS done, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 2) AS percent, round(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 1) AS left_over, '[' || string_agg(DISTINCT '"' || o_orderstatus || '"', ',' ORDER BY '"' || o_orderstatus || '"') || ']' AS states FROM orders GROUP BY 1""")
def path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of each path, its states as a JSON array."""
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("path"))
    return rows.agg(F.count("*").alias("tickets"), done.alias("done"), F.round(100.0 * done / F.count("*"), 2).alias("percent"), F.round(F.sum(F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))), 1).alias("left_over"), F.to_json(F.array_sort(F.collect_set("o_orderstatus"))).alias("states"))
