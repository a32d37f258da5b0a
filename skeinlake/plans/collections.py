"""Queries with arrays, maps and JSON: containment, aggregates into objects, distributions, positions and trims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks
from .projection import read
from .registry import query, typed


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticket and its sorted set of concepts: the parts of an order, of which there are few."""
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ticket")).agg(F.array_sort(F.collect_set("l_partkey")).alias("concepts"))


_TAGS_SQL = "tags AS (SELECT l_orderkey AS ticket, list_sort(list(DISTINCT l_partkey)) AS concepts FROM lineitem GROUP BY 1)"


@query(f"WITH {_TAGS_SQL} SELECT ticket, len(concepts) AS n FROM tags WHERE list_has_any(concepts, [1, 2, 3, 5, 8]) AND NOT list_contains(concepts, 13)")
def tickets_of_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list parameter: any of its elements, and not one other."""
    wanted = F.array(*(F.lit(k).cast("long") for k in (1, 2, 3, 5, 8)))
    rows = _tags(spark, sf_dir).where(F.arrays_overlap("concepts", wanted) & ~F.array_contains("concepts", F.lit(13).cast("long")))
    return rows.select("ticket", F.size("concepts").cast("long").alias("n"))


@query(f"""WITH {_TAGS_SQL}, w AS (SELECT c_custkey AS learner, [c_custkey % 200, (c_custkey * 7) % 200] AS wanted FROM customer)
SELECT learner, ticket FROM w JOIN tags ON list_has_all(concepts, wanted)""")
def tickets_with_all_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment as an equality join on elements, once for each set that is wanted: a match is a pair with as many common elements as the set has."""
    wanted = F.array_distinct(F.array(F.col("c_custkey") % 200, (F.col("c_custkey") * 7) % 200))
    learners = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("learner"), wanted.alias("wanted"))
    asked = learners.select("wanted").distinct().select("wanted", F.explode("wanted").alias("concept"))
    tagged = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ticket"), F.col("l_partkey").alias("concept")).distinct()
    found = asked.join(tagged, "concept").groupBy("wanted", "ticket").agg(F.count("*").alias("hits")).where(F.col("hits") == F.size("wanted"))
    return learners.join(found, "wanted").select("learner", "ticket")


@query(f"WITH {_TAGS_SQL} SELECT ticket, array_to_string(concepts[1:3], ',') AS first_three, len(concepts) AS n, CASE WHEN len(concepts) > 3 THEN len(concepts) - 3 ELSE 0 END AS more FROM tags")
def ticket_concept_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size("concepts").cast("long")
    return _tags(spark, sf_dir).select("ticket", F.array_join(F.slice("concepts", 1, 3).cast("array<string>"), ",").alias("first_three"), n.alias("n"), F.greatest(n - 3, F.lit(0)).alias("more"))


@query("""SELECT o_orderkey AS ticket, coalesce((SELECT string_agg(l_linenumber || '=' || l_returnflag, ';' ORDER BY l_linenumber, l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25), '') AS fields,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25) AS n FROM orders""")
def ticket_field_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name and value pairs of each ticket that pass a filter, as one object; a ticket without any has an empty one."""
    pairs = read(spark, sf_dir, "lineitem").where("l_quantity > 25").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("pairs"))
    rows = read(spark, sf_dir, "orders").join(pairs, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    written = F.array_join(F.transform("pairs", lambda p: F.concat(p["l_linenumber"].cast("string"), F.lit("="), p["l_returnflag"])), ";")
    return rows.select(F.col("o_orderkey").alias("ticket"), F.coalesce(written, F.lit("")).alias("fields"), F.coalesce(F.size("pairs"), F.lit(0)).cast("long").alias("n"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS ticket, '[' || string_agg('{"name":"field_' || l_linenumber || '","value":"' || flag || '"}', ',' ORDER BY l_linenumber) || ']' AS fields, round(max(CASE WHEN l_linenumber = 1 THEN quantity END), 2) AS first_quantity FROM f GROUP BY 1""")
def ticket_fields_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON array of objects for each ticket, and one of its values looked up in a map."""
    fields = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"))
    rows = fields.groupBy(F.col("l_orderkey").alias("ticket")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "flag", "quantity"))).alias("f"))
    objects = F.transform("f", lambda x: F.struct(F.concat(F.lit("field_"), x["l_linenumber"].cast("string")).alias("name"), x["flag"].alias("value")))
    values = F.map_from_entries(F.transform("f", lambda x: F.struct(x["l_linenumber"], x["quantity"])))
    return rows.select("ticket", F.to_json(objects).alias("fields"), F.round(values[1], 2).alias("first_quantity"))


@query("SELECT user_id AS learner, json_extract_string(props, '$.k') AS concept, len(json_keys(props)) AS keys, list_contains(json_keys(props), 'k') AS has_k FROM events WHERE event_id % 7 = 0")
def property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of properties as an array, searched for one by part of its name."""
    keys = F.json_object_keys("props")
    return read(spark, sf_dir, "events").where("event_id % 7 = 0").select(F.col("user_id").alias("learner"), F.get_json_object("props", "$.k").alias("concept"), F.size(keys).cast("long").alias("keys"), F.exists(keys, lambda k: k.contains("k")).alias("has_k"))


@query("""SELECT source, count(*) AS chunks, string_agg(lang || ':' || n, ',' ORDER BY lang) AS languages, max(n) / sum(n) AS mode_share FROM (SELECT coalesce(source, '') AS source, coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY 1, 2) GROUP BY 1""")
def language_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distribution as a map in text, and the share of its commonest value: two small aggregations."""
    counts = read(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat_ws(":", "lang", "n")))
    return counts.groupBy("source").agg(F.count("*").alias("chunks"), F.array_join(pairs, ",").alias("languages"), (F.max("n") / F.sum("n")).alias("mode_share"))


def _at(values: str, share: Column) -> Column:
    """The element at floor(share * n) of a sorted array, without interpolation."""
    return F.element_at(values, (F.floor(F.size(values) * share) + 1).cast("int"))


@query("""WITH s AS (SELECT lang, list_sort(list(n_chars)) AS v FROM documents WHERE n_chars IS NOT NULL GROUP BY 1)
SELECT lang, v[len(v) // 4 + 1] AS q1, v[len(v) // 2 + 1] AS upper_median, v[3 * len(v) // 4 + 1] AS q3, round(len(list_filter(v, lambda x: x BETWEEN 800 AND 1600)) / len(v), 6) AS in_range FROM s""")
def chunk_size_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes by position: the distinct sizes of a language are counted first, so that a task holds counts and not rows."""
    counts = read(spark, sf_dir, "documents").where("n_chars IS NOT NULL").groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    by_size = Window.partitionBy("lang").orderBy("n_chars")
    placed = counts.withColumns({"end": F.sum("n").over(by_size), "total": F.sum("n").over(Window.partitionBy("lang"))})
    at = lambda part: F.max(F.when((F.col("end") > part) & (F.col("end") - F.col("n") <= part), F.col("n_chars")))
    total = F.col("total")
    return placed.groupBy("lang").agg(
        at(F.floor(total / 4)).alias("q1"), at(F.floor(total / 2)).alias("upper_median"), at(F.floor(3 * total / 4)).alias("q3"),
        F.round(F.sum(F.when(F.col("n_chars").between(800, 1600), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("in_range"))


@query("""SELECT event_type AS model, count(*) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS spread, round(min(value), 4) AS least, round(max(value), 4) AS most, count(*) FILTER (value >= 70) AS passed,
  round(1 - count(*) FILTER (value >= 70) / count(*), 6) AS failure_rate, count(*) FILTER (value >= 90) AS grade_a, count(*) FILTER (value >= 80 AND value < 90) AS grade_b FROM events GROUP BY 1""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality statistics of a batch by model: one pass, partial sums in each task."""
    v = F.col("value")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg(
        F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("spread"), F.round(F.min(v), 4).alias("least"), F.round(F.max(v), 4).alias("most"), F.count(F.when(v >= 70, 1)).alias("passed"),
        F.round(1 - F.count(F.when(v >= 70, 1)) / F.count("*"), 6).alias("failure_rate"), F.count(F.when(v >= 90, 1)).alias("grade_a"), F.count(F.when((v >= 80) & (v < 90), 1)).alias("grade_b"))


@query("""SELECT o_orderpriority AS priority, round(avg(CASE WHEN o_orderpriority <> '' THEN try_cast(substr(o_orderpriority, 1, 1) AS DOUBLE) END), 6) AS mean_grade, count(*) AS n FROM orders GROUP BY 1""")
def mean_grade_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.substring("o_orderpriority", 1, 1).try_cast("double")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.round(F.avg(F.when(F.col("o_orderpriority") != "", digit)), 6).alias("mean_grade"), F.count("*").alias("n"))


@query("""SELECT a.event_id, a.user_id AS learner, d.doc_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS i FROM events) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) d USING (i)""")
def zipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables by position: each is numbered in parallel, by ranges of its key, and joined on the number."""
    events = ranks.numbered(read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("learner")), "event_id", "i")
    return events.join(ranks.numbered(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", "i"), "i").select("event_id", "learner", "doc_id")


@query(typed(f"""WITH {_TAGS_SQL}, r AS (SELECT ticket, len(concepts) AS n, sum(len(concepts)) OVER (PARTITION BY ticket % 50 ORDER BY ticket) AS total FROM tags)
SELECT ticket % 50 AS segment, ticket, CASE WHEN total <= 40 THEN n ELSE 40 - (total - n) END AS taken FROM r WHERE total - n < 40""", taken="BIGINT"))
def budget_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each segment until the budget of 40 is spent; the last one is cut."""
    rows = _tags(spark, sf_dir).select((F.col("ticket") % 50).alias("segment"), "ticket", F.size("concepts").cast("long").alias("n"))
    rows = ranks.running_sum(rows, "n", "ticket", "total", "segment")
    return rows.where("total - n < 40").select("segment", "ticket", F.when(F.col("total") <= 40, F.col("n")).otherwise(40 - F.col("total") + F.col("n")).alias("taken"))


@query("""WITH u AS (SELECT DISTINCT o_custkey AS learner, o_orderkey AS item, 1 AS source FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT DISTINCT o_custkey, o_orderkey, 2 FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT DISTINCT o_custkey, o_orderkey, 3 FROM orders WHERE o_orderstatus = 'O'),
f AS (SELECT learner, item, min(source) AS source FROM u GROUP BY 1, 2) SELECT * FROM (SELECT learner, item, source, row_number() OVER (PARTITION BY learner ORDER BY source, item) AS place FROM f) WHERE place <= 10""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from several sources in order of the sources, each item once under its first one; ten for each learner."""
    orders = read(spark, sf_dir, "orders")
    source = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_totalprice") > 200_000, 2).when(F.col("o_orderstatus") == "O", 3)
    found = orders.select(F.col("o_custkey").alias("learner"), F.col("o_orderkey").alias("item"), source.alias("source")).where("source IS NOT NULL").groupBy("learner", "item").agg(F.min("source").alias("source"))
    place = F.row_number().over(Window.partitionBy("learner").orderBy("source", "item"))
    return found.withColumn("place", place.cast("long")).where("place <= 10")


@query("""SELECT c_custkey AS learner, CASE WHEN a >= b AND a >= c THEN 'balance' WHEN b >= c THEN 'segment' ELSE 'place' END AS factor, round(greatest(a, b, c), 6) AS weight
  FROM (SELECT c_custkey, abs(c_acctbal) / 10000 * 0.5 AS a, length(c_mktsegment) / 20 AS b, c_nationkey / 25 AS c FROM customer)""")
def leading_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest of several weighted factors and its name: greatest over structs; of equal ones, the first named."""
    factors = [("balance", F.abs("c_acctbal") / 10000 * 0.5), ("segment", F.length("c_mktsegment") / 20), ("place", F.col("c_nationkey") / 25)]
    best = F.greatest(*(F.struct(w.alias("w"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, w) in enumerate(factors)))
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("learner"), best["name"].alias("factor"), F.round(best["w"], 6).alias("weight"))


@query("SELECT count(*) AS chunks, count(next_id) AS linked, round(count(*) FILTER (next_id IS NOT NULL OR prev_id IS NOT NULL) / count(*), 6) AS connectivity FROM (SELECT lead(doc_id) OVER w AS next_id, lag(doc_id) OVER w AS prev_id FROM documents WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id))")
def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of chunks with a neighbour in their sequence.  A sequence of n chunks has n - 1 links, so counts do."""
    sizes = read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return sizes.agg(F.sum("n").alias("chunks"), F.sum(F.col("n") - 1).alias("linked"), F.round(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("connectivity"))
