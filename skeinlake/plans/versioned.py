"""Tables that change by commits: several at once, slices of a batch, a log, an incremental view; and what footers and keys say of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commits, views
from ..operators.lineage import fresh_path
from ..sources import footers
from .projection import read
from .registry import query, typed


@query("SELECT o_orderkey AS ticket, o_orderstatus AS status, count(l_orderkey) AS fields FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2")
def two_table_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets and their fields written as one version, then read together."""
    root = fresh_path(spark, "tickets")
    tickets, fields = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket"), F.col("o_orderstatus").alias("status")), read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ticket"), F.col("l_linenumber").alias("field"))
    commits.commit(spark, root, {"tickets": tickets, "fields": fields})
    counts = commits.read(spark, root, "fields").groupBy("ticket").agg(F.count("*").alias("fields"))
    return commits.read(spark, root, "tickets").join(counts, "ticket", "left").select("ticket", "status", F.coalesce("fields", F.lit(0)).alias("fields"))


@query("""WITH n AS (SELECT o_totalprice, o_orderstatus, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS slice, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders), e AS (SELECT slice, place, CASE WHEN NOT o_totalprice > 0 THEN 'price' WHEN NOT o_totalprice < 499000 THEN 'limit' END AS error FROM n)
SELECT slice, count(*) AS rows, count(error) AS failed, arg_min(error, place) FILTER (error IS NOT NULL) AS error, count(error) = 0 AS written FROM e GROUP BY 1""")
def sliced_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch in slices of a thousand, each written whole or not at all, and what became of each."""
    rules = {"price": F.col("o_totalprice") > 0, "limit": F.col("o_totalprice") < 499_000}
    return commits.write_slices(read(spark, sf_dir, "orders"), "o_orderkey", rules)[1]


@query("SELECT user_id, event_type AS query, count(*) AS hits FROM events GROUP BY 1, 2")
def search_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that grows by two appended batches, read as one table."""
    root, events = fresh_path(spark, "log"), read(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    for half in (0, 1):
        commits.append(spark, root, "searches", events.where(F.col("event_id") % 2 == half))
    return commits.read(spark, root, "searches").groupBy("user_id", F.col("event_type").alias("query")).agg(F.count("*").alias("hits"))


_TYPES = ("long", "double", "long")


@query(typed("""WITH base AS (SELECT event_id AS id, user_id AS key, value FROM events WHERE event_id % 10 <> 3), new AS (
  SELECT event_id, user_id, value FROM events WHERE event_id % 10 = 3 UNION ALL SELECT event_id, (user_id + 1) % 50, value + 1 FROM events WHERE event_id % 10 <> 3 AND event_id % 11 = 0 AND event_id % 7 <> 0),
gone AS (SELECT event_id FROM events WHERE event_id % 10 <> 3 AND event_id % 7 = 0), every AS (SELECT * FROM base WHERE id NOT IN (FROM gone) AND id NOT IN (SELECT event_id FROM new) UNION ALL FROM new)
SELECT key, count(*) AS n, round(sum(value), 3) AS total, min(value) AS least, max(value) AS most FROM every GROUP BY 1""", key="BIGINT"))
def incremental_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by learner, refreshed after inserts, updates that move rows to other learners, and deletes: only their buckets are written."""
    root, events = fresh_path(spark, "view"), read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("long").alias("key"), "value")
    views.create(spark, root, events.where("id % 10 <> 3"))
    new = events.where("id % 10 = 3").withColumn("deleted", F.lit(False))
    gone = events.where("id % 10 <> 3 AND id % 7 = 0").withColumn("deleted", F.lit(True))
    moved = events.where("id % 10 <> 3 AND id % 11 = 0 AND id % 7 <> 0").withColumns({"key": (F.col("key") + 1) % 50, "value": F.col("value") + 1, "deleted": F.lit(False)})
    views.refresh(spark, root, new.unionByName(gone), _TYPES)
    views.refresh(spark, root, moved, _TYPES)
    return views.view(spark, root, _TYPES).select("key", "n", F.round(F.col("total").cast("double"), 3).alias("total"), "least", "most")


#: Tables and number columns that the catalogue describes.
_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey", "events": "event_id", "documents": "doc_id", "pages": "page_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, CAST(min({c}) AS BIGINT) AS least, CAST(max({c}) AS BIGINT) AS greatest FROM {t}" for t, c in _KEYS.items()))
def column_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls, least and greatest of key columns, from the footers of the files alone."""
    rows = footers.footers(spark, {t: f"{sf_dir}/{t}.parquet" for t in _KEYS}, list(_KEYS.values()))
    return footers.summary(rows).select("table", "column", "rows", "nulls", "least", "greatest")


_REFERENCES = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("documents", "doc_id", "labels", "doc_id")]


@query(typed(" UNION ALL ".join([f"SELECT '{t}.{c}' AS declared, 'key' AS kind, count(*) AS rows, count(*) - count(DISTINCT {c}) AS failures FROM {t}" for t, c in _KEYS.items()] + [f"SELECT '{t}.{c}', 'reference', count({c}), count({c}) FILTER ({c} NOT IN (SELECT {k} FROM {o})) FROM {t}" for t, c, o, k in _REFERENCES]), failures="BIGINT"))
def declared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared keys and references held against the rows, with the number of rows that fail each."""
    found = None
    for t, c in _KEYS.items():
        part = footers.key_check(read(spark, sf_dir, t), [c]).select(F.lit(f"{t}.{c}").alias("declared"), F.lit("key").alias("kind"), "rows", (F.col("rows") - F.col("keys")).alias("failures"))
        found = part if found is None else found.unionByName(part)
    for t, c, o, k in _REFERENCES:
        part = footers.reference_check(read(spark, sf_dir, t), c, read(spark, sf_dir, o), k).select(F.lit(f"{t}.{c}").alias("declared"), F.lit("reference").alias("kind"), "rows", F.col("missing").alias("failures"))
        found = found.unionByName(part)
    return found
