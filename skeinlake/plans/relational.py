"""Relational queries of the learning platform: tickets (orders), their attributes, learners (customers), milestones (nations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks, upserts
from ..operators.lineage import cut
from .projection import LEARNER_EVENTS_SQL, learner_events, read
from .registry import query

#: Order of ticket priorities.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
#: Least price of each band.
BANDS = ((0.0, "small"), (50_000.0, "middle"), (150_000.0, "large"), (250_000.0, "huge"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS tickets, count(DISTINCT o_custkey) AS owners FROM orders GROUP BY 1, 2")
def ticket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("tickets"), F.count_distinct("o_custkey").alias("owners"))


@query("""SELECT (SELECT count(*) FROM orders) AS tickets, (SELECT count(*) FROM lineitem) AS fields, (SELECT count(*) FROM customer) AS learners,
  (SELECT count(DISTINCT user_id) FROM events) AS active, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS chunks""")
def service_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, what, alias: F.broadcast(read(spark, sf_dir, name).agg(what.alias(alias)))  # noqa: E731  one row each
    out = one("orders", F.count("*"), "tickets").crossJoin(one("lineitem", F.count("*"), "fields")).crossJoin(one("customer", F.count("*"), "learners"))
    return out.crossJoin(one("events", F.count_distinct("user_id"), "active")).crossJoin(one("documents", F.count("text"), "chunks"))


@query("""SELECT o_orderkey AS ticket, name, value FROM (SELECT o_orderkey, unnest(['status', 'priority', 'owner']) AS name, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) AS value FROM orders) WHERE value IS NOT NULL""")
def attribute_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("owner"))
    return upserts.unpivot_attributes(rows, "ticket", ["status", "priority", "owner"])


@query("""SELECT l_orderkey AS ticket, max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS field_1, max(CASE WHEN l_linenumber = 2 THEN l_returnflag END) AS field_2,
  max(CASE WHEN l_linenumber = 3 THEN l_returnflag END) AS field_3 FROM lineitem GROUP BY 1""")
def attribute_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ticket"), F.concat(F.lit("field_"), F.col("l_linenumber")).alias("name"), F.col("l_returnflag").alias("value"))
    return upserts.pivot_attributes(fields, "ticket", ["field_1", "field_2", "field_3"])


_FIELDS_SQL = "f AS (SELECT l_orderkey, count(*) AS fields, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1)"


@query(f"""WITH {_FIELDS_SQL} SELECT o_orderkey AS ticket, c_name AS owner, n_name AS milestone, o_orderstatus AS status, coalesce(fields, 0) AS fields, coalesce(quantity, 0) AS quantity
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN f ON l_orderkey = o_orderkey""")
def ticket_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each branch is aggregated before its join, so that no join multiplies rows."""
    fields = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("fields"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    owners = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = read(spark, sf_dir, "orders").join(fields, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(owners, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("o_orderkey").alias("ticket"), F.col("c_name").alias("owner"), F.col("n_name").alias("milestone"), F.col("o_orderstatus").alias("status"), F.coalesce("fields", F.lit(0)).alias("fields"), F.coalesce("quantity", F.lit(0.0)).alias("quantity"))


@query("""SELECT n_name AS milestone, o_orderkey AS ticket, place FROM (
  SELECT n_name, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) WHERE place <= 5""")
def newest_per_milestone(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    place = F.row_number().over(Window.partitionBy("n_name").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return rows.select(F.col("n_name").alias("milestone"), F.col("o_orderkey").alias("ticket"), place.cast("long").alias("place")).where("place <= 5")


@query("""SELECT r_name AS region, n_name AS milestone, grouping(n_name) AS level, count(*) AS submissions, round(sum(l_extendedprice * (1 - l_discount)), 1) AS points
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def submission_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = F.broadcast(read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")))  # 25 rows
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("r_name").alias("region"), F.col("n_name").alias("milestone"), "l_extendedprice", "l_discount").rollup("region", "milestone").agg(F.grouping("milestone").cast("long").alias("level"), F.count("*").alias("submissions"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 1).alias("points"))


@query("SELECT c_custkey AS learner, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def learners_without_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("learner"), F.col("c_name").alias("name"))


@query("SELECT o_orderkey AS ticket, o_totalprice AS price FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def tickets_with_large_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = read(spark, sf_dir, "lineitem").where("l_quantity >= 49")
    return read(spark, sf_dir, "orders").join(large, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_orderkey").alias("ticket"), F.col("o_totalprice").alias("price"))


@query("""SELECT 'no ticket' AS reason, l_orderkey AS key FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey) GROUP BY 2
  UNION ALL SELECT 'no owner', o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)""")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    fields = read(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("no ticket").alias("reason"), F.col("l_orderkey").alias("key"))
    owners = orders.join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("no owner").alias("reason"), F.col("o_orderkey").alias("key"))
    return fields.unionByName(owners)


@query("""SELECT n_name AS milestone, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS learners, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS authors FROM nation""")
def learners_and_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    learners = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("learners"))
    authors = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("authors"))
    rows = read(spark, sf_dir, "nation").join(learners, "n_nationkey", "left").join(authors, "n_nationkey", "left")
    return rows.select(F.col("n_name").alias("milestone"), F.coalesce("learners", F.lit(0)).alias("learners"), F.coalesce("authors", F.lit(0)).alias("authors"))


@query("""SELECT n_name AS milestone, s.status, count(o_orderkey) AS tickets FROM nation CROSS JOIN (SELECT DISTINCT o_orderstatus AS status FROM orders) s
  LEFT JOIN (SELECT * FROM orders JOIN customer ON c_custkey = o_custkey) o ON o.c_nationkey = n_nationkey AND o.o_orderstatus = s.status GROUP BY 1, 2""")
def milestone_status_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 25 x 3 cells, empty ones too: tickets are counted by cell before they meet the grid."""
    orders, nation = read(spark, sf_dir, "orders"), read(spark, sf_dir, "nation")
    counts = orders.join(read(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_nationkey").alias("n_nationkey"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("tickets"))
    grid = nation.select("n_nationkey", F.col("n_name").alias("milestone")).crossJoin(F.broadcast(orders.select(F.col("o_orderstatus").alias("status")).distinct()))
    return grid.join(counts, ["n_nationkey", "status"], "left").select("milestone", "status", F.coalesce("tickets", F.lit(0)).alias("tickets"))


@query("""SELECT n_name AS milestone, count(*) AS events, count(DISTINCT user_id) AS students FROM events JOIN nation ON CAST(json_extract_string(props, '$.k') AS INTEGER) % 25 = n_nationkey GROUP BY 1""")
def json_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.get_json_object("props", "$.k").cast("int") % 25
    return read(spark, sf_dir, "events").join(F.broadcast(read(spark, sf_dir, "nation")), key == F.col("n_nationkey")).groupBy(F.col("n_name").alias("milestone")).agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("students"))


@query(f"""SELECT o_orderkey AS ticket, e.value AS urgency FROM orders JOIN (VALUES {", ".join(f"('{p}', {k})" for k, p in enumerate(PRIORITIES, 1))}) e(name, value) ON name = o_orderpriority WHERE o_orderstatus <> 'F'""")
def active_tickets_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    enum = spark.createDataFrame([(p, k) for k, p in enumerate(PRIORITIES, 1)], "name string, urgency int")
    return read(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").join(F.broadcast(enum), F.col("name") == F.col("o_orderpriority")).select(F.col("o_orderkey").alias("ticket"), "urgency")


_BANDS_SQL = ", ".join(f"({low}, '{name}')" for low, name in BANDS)


@query(f"""WITH b AS (SELECT low, band, lead(low) OVER (ORDER BY low) AS high FROM (VALUES {_BANDS_SQL}) v(low, band))
SELECT band, count(*) AS tickets, max(o_totalprice) AS most FROM orders JOIN b ON o_totalprice >= low AND (high IS NULL OR o_totalprice < high) GROUP BY 1""")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lies in one of few intervals: an expression does what a range join would."""
    band = F.lit(BANDS[0][1])
    for low, name in BANDS[1:]:
        band = F.when(F.col("o_totalprice") >= low, name).otherwise(band)
    return read(spark, sf_dir, "orders").groupBy(band.alias("band")).agg(F.count("*").alias("tickets"), F.max("o_totalprice").alias("most"))


@query("""SELECT event_id, viewed FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS viewed FROM events) WHERE event_type = 'purchase'""")
def last_view_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of join by one window: each purchase with its learner's latest view at or before it."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    viewed = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(order)
    return read(spark, sf_dir, "events").withColumn("viewed", viewed).where("event_type = 'purchase'").select("event_id", "viewed")


@query("""SELECT o_orderpriority AS priority, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.9) AS p90, round(stddev_samp(o_totalprice), 3) AS spread, round(var_pop(o_totalprice) / 1e6, 3) AS variance,
  min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY 1""")
def price_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, orders = F.col("o_totalprice"), read(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority")
    plain = orders.groupBy("priority").agg(F.round(F.stddev_samp(price), 3).alias("spread"), F.round(F.var_pop(price) / 1e6, 3).alias("variance"), F.min(price).alias("least"), F.max(price).alias("most"))
    return plain.join(ranks.percentiles(orders, "o_totalprice", {"median": 0.5, "p90": 0.9}, "priority"), "priority", "left")


@query(f"""WITH {LEARNER_EVENTS_SQL} SELECT student_id, string_agg(CAST(concept_id AS VARCHAR), ',' ORDER BY concept_id) AS concepts FROM (SELECT DISTINCT student_id, concept_id FROM learner_events WHERE status = 'mastered') GROUP BY 1""")
def mastered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = learner_events(spark, sf_dir).where("status = 'mastered'").groupBy("student_id").agg(F.sort_array(F.collect_set("concept_id")).alias("c"))
    return rows.select("student_id", F.array_join(F.transform("c", lambda x: x.cast("string")), ",").alias("concepts"))


@query("""SELECT event_id, row_number() OVER w AS n, rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS r, dense_rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS d, ntile(4) OVER w AS quarter,
  lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, first_value(event_id) OVER w AS first FROM events WINDOW w AS (PARTITION BY event_type ORDER BY value DESC, event_id)""")
def window_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks in five groups that hold all events: rows are numbered by ranges of their order, and all else follows from the numbers."""
    rows = ranks.numbered(read(spark, sf_dir, "events").select("event_id", "event_type", "value"), [F.desc("value"), "event_id"], "n", "event_type")
    rows = cut(rows)
    values = rows.groupBy("event_type", "value").agg(F.min("n").alias("r"))
    values = ranks.numbered(values, [F.desc("value")], "d", "event_type")
    sizes = rows.groupBy("event_type").agg(F.max("n").alias("size"), F.max(F.when(F.col("n") == 1, F.col("event_id"))).alias("first"))  # a row for each group
    rows = ranks.beside(rows, "n", -1, {"before": "event_id"}, "event_type")
    later = rows.select("event_id", "event_type", "n", "value", "before")
    rows = ranks.beside(later, "n", 2, {"after": "event_id"}, "event_type").join(values, ["event_type", "value"]).join(sizes, "event_type")
    n, base, rest = F.col("n"), F.floor(F.col("size") / 4), F.col("size") % 4
    wide = rest * (base + 1)
    quarter = F.when(n <= wide, F.floor((n - 1) / (base + 1)) + 1).otherwise(rest + F.floor((n - 1 - wide) / base) + 1)
    return rows.select("event_id", n.cast("long").alias("n"), F.col("r").cast("long").alias("r"), F.col("d").cast("long").alias("d"), quarter.cast("long").alias("quarter"), "before", "after", "first")


@query("""WITH d AS (SELECT user_id AS student_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
SELECT student_id, day, n, CAST(sum(n) OVER (PARTITION BY student_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS week FROM d""")
def rolling_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("student_id"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("student_id").orderBy(F.unix_date("day")).rangeBetween(-6, 0)
    return days.withColumn("week", F.sum("n").over(order))


_SETS_SQL = "v AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'view'), p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')"


@query(f"""WITH {_SETS_SQL} SELECT 'both' AS kind, user_id FROM (SELECT * FROM v INTERSECT SELECT * FROM p) UNION ALL SELECT 'views only', user_id FROM (SELECT * FROM v EXCEPT SELECT * FROM p)
  UNION ALL SELECT 'either', user_id FROM (SELECT * FROM v UNION SELECT * FROM p)""")
def learner_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the events decides all three sets."""
    seen = lambda kind: F.max((F.col("event_type") == kind).cast("int")) == 1
    flags = read(spark, sf_dir, "events").groupBy("user_id").agg(seen("view").alias("v"), seen("purchase").alias("p"))
    kinds = F.array_compact(F.array(F.when(F.col("v") & F.col("p"), "both"), F.when(F.col("v") & ~F.col("p"), "views only"), F.when(F.col("v") | F.col("p"), "either")))
    return flags.select(F.explode(kinds).alias("kind"), "user_id")


@query("SELECT p_partkey AS course, p_name AS title FROM part WHERE p_brand <> 'none' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def course_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").where("p_brand <> 'none'").orderBy("p_name", "p_partkey").offset(40).limit(20).select(F.col("p_partkey").alias("course"), F.col("p_name").alias("title"))


_HALVES_SQL = "old AS (SELECT o_orderkey AS k, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0), new AS (SELECT o_orderkey AS k, o_orderpriority AS status FROM orders WHERE o_orderkey % 2 = 0)"


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return orders.where(key % 3 != 0).select(key.alias("k"), F.col("o_orderstatus").alias("status")), orders.where(key % 2 == 0).select(key.alias("k"), F.col("o_orderpriority").alias("status"))


@query(f"WITH {_HALVES_SQL} SELECT * FROM old UNION ALL SELECT * FROM new WHERE k NOT IN (SELECT k FROM old)")
def insert_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upserts.insert_ignore(*_halves(spark, sf_dir), ["k"])


@query(f"WITH {_HALVES_SQL} SELECT coalesce(n.k, o.k) AS k, coalesce(n.status, o.status) AS status, CAST((n.k IS NOT NULL)::INT + (o.k IS NOT NULL)::INT AS INTEGER) AS writes FROM old o FULL JOIN new n ON n.k = o.k")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"status": F.coalesce("new.status", "old.status"), "writes": F.col("new.k").isNotNull().cast("int") + F.col("old.k").isNotNull().cast("int")}
    return upserts.accumulate(*_halves(spark, sf_dir), ["k"], rules)


@query(f"WITH {_HALVES_SQL} SELECT k, field, before, after FROM (SELECT n.k, unnest(['status', 'resolution']) AS field, unnest([o.status, 'open']) AS before, unnest([n.status, 'mastered']) AS after FROM new n JOIN old o ON o.k = n.k) WHERE before <> after")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _halves(spark, sf_dir)
    pair = lambda field, a, b: F.struct(F.lit(field).alias("field"), a.alias("before"), b.alias("after"))
    rows = new.alias("n").join(old.alias("o"), "k").select("k", F.explode(F.array(pair("status", F.col("o.status"), F.col("n.status")), pair("resolution", F.lit("open"), F.lit("mastered")))).alias("c"))
    return rows.select("k", "c.field", "c.before", "c.after").where("before <> after")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascading_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    return read(spark, sf_dir, "lineitem").join(gone, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("l_orderkey", "l_linenumber")


@query("""SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS attempts, round(avg(value) + 1e-12, 6) AS mean, round(corr(value, user_id), 5) AS trend FROM events GROUP BY 1, 2""")
def score_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).alias("week"), "event_type").agg(F.count("*").alias("attempts"), F.round(F.avg("value") + 1e-12, 6).alias("mean"), F.round(F.corr("value", "user_id"), 5).alias("trend"))


@query("""SELECT o_custkey AS learner, count(*) AS enrolled, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, round(count(*) FILTER (WHERE o_orderstatus = 'F') * 100.0 / nullif(count(*), 0), 2) AS rate,
  round(avg(TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE)) + 1e-12, 6) AS grade FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def completion_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.count(F.when(F.col("o_orderstatus") == "F", 1))
    rows = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("learner")).agg(
        F.count("*").alias("enrolled"), done.alias("completed"), F.round(F.try_divide(done * F.lit(100.0), F.count("*")), 2).alias("rate"), F.round(F.avg(F.substring("o_orderpriority", 1, 1).try_cast("double")) + 1e-12, 6).alias("grade"))
    return rows.where("enrolled >= 3")


@query("SELECT conv_id, count(*) AS turns, string_agg(role, '>' ORDER BY turn, role) AS roles, max(length(text)) AS longest FROM conversations GROUP BY 1")
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(roles, ">").alias("roles"), F.max(F.length("text")).alias("longest"))


@query("""SELECT source AS book, lang, count(*) AS chunks, count(text) AS with_text, count(*) FILTER (WHERE text ILIKE '%http%') AS with_links, CAST(sum(n_chars) AS BIGINT) AS characters, count(*) FILTER (WHERE quality = 1) AS good
  FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) GROUP BY 1, 2""")
def content_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left").groupBy(F.col("source").alias("book"), "lang").agg(
        F.count("*").alias("chunks"), F.count("text").alias("with_text"), F.count(F.when(F.col("text").ilike("%http%"), 1)).alias("with_links"), F.sum("n_chars").alias("characters"), F.count(F.when(F.col("quality") == 1, 1)).alias("good"))
