"""Queries of learning paths and what is recorded about them: the current path, pages of paths, measures and insights, rows inserted for a path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import commits, progress
from ..operators.lineage import fresh_path
from .projection import read
from .registry import query, typed

#: Every seventh profile points one order too far: to another learner's path, or to none.
_POINTERS_SQL = "p AS (SELECT c_custkey AS learner, (SELECT CASE WHEN c_custkey % 7 = 0 THEN arg_max(o_orderkey, (o_orderdate, o_orderkey)) + 1 ELSE arg_max(o_orderkey, (o_orderdate, o_orderkey)) END FROM orders WHERE o_custkey = c_custkey) AS path_id FROM customer)"


@query(typed(f"""WITH {_POINTERS_SQL}, l AS (SELECT user_id AS learner, CAST(json_extract_string(props, '$.k') AS BIGINT) AS chunk, arg_max(least(1.0, value / 20), (ts, event_id)) AS level FROM events GROUP BY 1, 2),
h AS (SELECT p.learner, p.path_id, o_orderkey IS NOT NULL AS found FROM p LEFT JOIN orders ON o_orderkey = p.path_id AND o_custkey = p.learner),
c AS (SELECT h.learner, h.path_id, count(*) AS total, count(*) FILTER (level >= 0.7) AS done FROM h JOIN lineitem ON l_orderkey = h.path_id LEFT JOIN l ON l.learner = h.learner AND l.chunk = l_partkey % 100 WHERE found GROUP BY 1, 2)
SELECT h.learner, h.path_id, CASE WHEN h.path_id IS NULL THEN 'none' WHEN found THEN 'active' ELSE 'not found' END AS state, coalesce(total, 0) AS total_chunks, coalesce(done, 0) AS completed_chunks, coalesce(round(100.0 * done / total, 4), 0) AS percentage
FROM h LEFT JOIN c ON c.learner = h.learner AND c.path_id = h.path_id""", total_chunks="BIGINT", completed_chunks="BIGINT", percentage="DOUBLE"))
def current_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path that each learner's profile points to, with the share of its chunks that the learner's newest levels complete."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path_id"), F.col("o_custkey").alias("learner"), "o_orderdate")
    newest = orders.groupBy("learner").agg(F.max_by("path_id", F.struct("o_orderdate", "path_id")).alias("newest"))
    pointer = F.when(F.col("learner") % 7 == 0, F.col("newest") + 1).otherwise(F.col("newest"))
    profiles = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("learner")).join(newest, "learner", "left").select("learner", pointer.alias("path_id"))
    segments = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path_id"), (F.col("l_partkey") % 100).alias("chunk"))
    levels = read(spark, sf_dir, "events").select(F.col("user_id").alias("learner"), F.get_json_object("props", "$.k").cast("long").alias("chunk"), F.least(F.lit(1.0), F.col("value") / 20).alias("level"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return progress.current_paths(profiles, orders, segments, levels)


#: Paths are parts: ten have one parent; a path asks for its half (which it must have) and its third.
_PATHS_SQL = """t AS (SELECT p_partkey AS id, p_name AS name, p_brand AS title, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent_id, p_size AS position, p_type AS difficulty FROM part),
r AS (SELECT id AS path_id, id // 2 AS prerequisite_id, true AS required FROM t UNION ALL SELECT id, id // 3, false FROM t)"""


@query(typed(f"""WITH {_PATHS_SQL}, k AS (SELECT parent_id AS id, count(*) AS children, string_agg(CAST(id AS VARCHAR), ',' ORDER BY position, name, id) AS child_ids, count(*) FILTER (difficulty LIKE 'ECONOMY%') AS easy FROM t WHERE parent_id IS NOT NULL GROUP BY 1),
q AS (SELECT path_id AS id, string_agg(CASE WHEN required THEN '!' ELSE '' END || p.id || ' ' || p.name, '; ' ORDER BY required DESC, p.position, p.id) AS prerequisites FROM r JOIN t p ON p.id = prerequisite_id GROUP BY 1),
s AS (SELECT ps_id AS id, string_agg(l || ':' || o, ',' ORDER BY l, o) AS resources FROM (SELECT l_partkey AS ps_id, l_linenumber AS l, l_orderkey AS o, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey) AS n FROM lineitem) WHERE n <= 5 GROUP BY 1)
SELECT t.id, name, title, parent_id, coalesce(children, 0) AS children, child_ids, coalesce(easy, 0) AS easy, prerequisites, resources FROM t LEFT JOIN k USING (id) LEFT JOIN q USING (id) LEFT JOIN s USING (id)""", children="BIGINT", easy="BIGINT"))
def path_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each path: its children by position and name, those of one difficulty counted, its prerequisites with the required ones first, and its first five resources."""
    part = read(spark, sf_dir, "part")
    paths = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("title"), F.when(F.col("p_partkey") >= 10, F.floor(F.col("p_partkey") / 10)).alias("parent_id"), F.col("p_size").alias("position"), F.col("p_type").alias("difficulty"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "name", "id")))
    easy = F.count(F.when(F.col("difficulty").startswith("ECONOMY"), 1))
    children = paths.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"), F.array_join(ordered["id"].cast("array<string>"), ",").alias("child_ids"), easy.alias("easy"))
    asked = F.explode(F.array(*(F.struct(F.floor(F.col("id") / n).alias("prerequisite_id"), F.lit(needed).alias("required")) for n, needed in ((2, True), (3, False)))))
    named = paths.select(F.col("id").alias("prerequisite_id"), "position", F.col("name").alias("asked_name"))
    asked = paths.select("id", asked.alias("r")).select("id", "r.*").join(named, "prerequisite_id")
    told = F.concat(F.when(F.col("required"), "!").otherwise(""), F.col("prerequisite_id").cast("string"), F.lit(" "), "asked_name")
    listed = F.array_sort(F.collect_list(F.struct((~F.col("required")).alias("late"), "position", "prerequisite_id", told.alias("told"))))
    prerequisites = asked.groupBy("id").agg(F.array_join(listed["told"], "; ").alias("prerequisites"))
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("place"), F.col("l_orderkey").alias("resource"))
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("place", "resource"))).where("n <= 5")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("place", "resource"))), lambda x: F.concat(x["place"].cast("string"), F.lit(":"), x["resource"].cast("string")))
    resources = first.groupBy("id").agg(F.array_join(shown, ",").alias("resources"))
    rows = paths.join(children, "id", "left").join(prerequisites, "id", "left").join(resources, "id", "left")
    return rows.select("id", "name", "title", "parent_id", F.coalesce("children", F.lit(0)).alias("children"), "child_ids", F.coalesce("easy", F.lit(0)).alias("easy"), "prerequisites", "resources")


@query(typed("""WITH a AS (SELECT user_id AS entity_id, event_id AS id, ts, event_type AS metric, round(value, 4) AS value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS concept, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '{"k":' || json_extract_string(props, '$.k') || ',"odd":' || CASE WHEN event_id % 2 = 1 THEN 'true' ELSE 'false' END || '}' END AS metadata FROM events),
m AS (SELECT entity_id, 'measure' AS record, id, metric AS kind, value, metadata, CASE WHEN metadata IS NOT NULL THEN concept END AS concept, ts FROM a), i AS (SELECT entity_id, 'insight' AS record, id, 'low ' || metric AS kind, round(1 - value / 100, 4) AS value, NULL AS metadata, NULL AS concept, ts FROM a WHERE value < 5 AND id % 4 <> 0)
SELECT entity_id, record, id, kind, value, metadata, concept, place FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, record ORDER BY ts DESC, id DESC) AS place FROM (FROM m UNION ALL FROM i)) WHERE place <= 100""", concept="BIGINT"))
def entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures with JSON metadata and insights, appended to their tables in several writes; the newest hundred of each kind for each learner, applied insights left out."""
    root, events = fresh_path(spark, "analytics"), read(spark, sf_dir, "events")
    base = events.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("id"), "ts", "event_type", F.round("value", 4).alias("value"), "props")
    note = F.when(F.col("id") % 3 != 0, F.to_json(F.struct(F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("id") % 2 == 1).alias("odd"))))
    measures = base.select("entity_id", "id", "ts", F.col("event_type").alias("kind"), "value", note.alias("metadata"))
    insights = base.where("value < 5").select("entity_id", "id", "ts", F.concat(F.lit("low "), "event_type").alias("kind"), F.round(1 - F.col("value") / 100, 4).alias("value"), (F.col("id") % 4 == 0).alias("applied"))
    for half in (0, 1):
        commits.append(spark, root, "measures", measures.where(F.col("id") % 2 == half))
    commits.append(spark, root, "insights", insights)
    told = commits.read(spark, root, "measures").withColumn("record", F.lit("measure"))
    open_ones = commits.read(spark, root, "insights").where("NOT applied").drop("applied").withColumns({"record": F.lit("insight"), "metadata": F.lit(None).cast("string")})
    place = F.row_number().over(Window.partitionBy("entity_id", "record").orderBy(F.desc("ts"), F.desc("id")))
    rows = told.unionByName(open_ones).withColumn("place", place.cast("long")).where("place <= 100")
    return rows.select("entity_id", "record", "id", "kind", "value", "metadata", F.get_json_object("metadata", "$.k").cast("long").alias("concept"), "place")


@query("""WITH f AS (SELECT o_custkey AS learner, min(o_orderkey) AS path_id FROM orders GROUP BY 1), n AS (SELECT path_id * 4 + 1 AS ticket, path_id, 'chunk-001' AS chunk, 0.95 AS relevance FROM f UNION ALL SELECT path_id + 2, path_id, 'chunk-002', 0.87 FROM f UNION ALL SELECT path_id, path_id, 'chunk-003', 0.92 FROM f),
old AS (SELECT o_orderkey AS ticket, o_orderkey AS path_id, 'chunk-000' AS chunk, 0.5 AS relevance FROM orders WHERE o_orderstatus = 'P')
SELECT ticket, path_id, chunk, CAST(relevance AS DOUBLE) AS relevance, o_orderstatus AS status FROM (FROM old UNION ALL FROM n) JOIN orders ON o_orderkey = ticket""")
def inserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inserted from a union of three selects over each learner's first path; those whose ticket is not there are refused, and what was there stays."""
    root, orders = fresh_path(spark, "chunk-metadata"), read(spark, sf_dir, "orders")
    tickets = orders.select(F.col("o_orderkey").alias("ticket"), F.col("o_orderstatus").alias("status"))
    old = tickets.where("status = 'P'").select("ticket", F.col("ticket").alias("path_id"), F.lit("chunk-000").alias("chunk"), F.lit(0.5).alias("relevance"))
    commits.append(spark, root, "metadata", old)
    path = orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("path_id"))
    row = lambda ticket, chunk, relevance: F.struct(ticket.alias("ticket"), F.lit(chunk).alias("chunk"), F.lit(relevance).alias("relevance"))
    id_ = F.col("path_id")
    new = path.select("path_id", F.inline(F.array(row(id_ * 4 + 1, "chunk-001", 0.95), row(id_ + 2, "chunk-002", 0.87), row(id_, "chunk-003", 0.92)))).select("ticket", "path_id", "chunk", "relevance")
    commits.append(spark, root, "metadata", new.join(tickets, "ticket", "left_semi"))
    return commits.read(spark, root, "metadata").join(tickets, "ticket").select("ticket", "path_id", "chunk", "relevance", "status")
