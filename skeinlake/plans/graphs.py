"""Queries of prerequisite graphs and of sequences of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph, ranks
from ..operators.lineage import cut
from .projection import CONCEPTS_SQL, PREREQUISITES_SQL, concepts, prerequisites, read
from .registry import query

_WITH = f"WITH RECURSIVE {CONCEPTS_SQL}, {PREREQUISITES_SQL}"


def _closure_sql(edge: str, hops: int) -> str:
    a, b = edge.split(">")
    return f"""{_WITH}, r AS (SELECT node AS start, node, 0 AS depth FROM concepts UNION SELECT r.start, p.{b}, r.depth + 1 FROM r JOIN prerequisites p ON p.{a} = r.node WHERE r.depth < {hops}),
c AS (SELECT start, node, min(depth) AS depth FROM r GROUP BY 1, 2)"""


#: All that each concept requires, at any depth.
_REACH_SQL = f"{_WITH}, c AS (SELECT node AS start, node FROM concepts UNION SELECT c.start, p.dst FROM c JOIN prerequisites p ON p.src = c.node)"


@query(_closure_sql("src>dst", 5) + " SELECT * FROM c WHERE depth > 0")
def prerequisite_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(prerequisites(spark, sf_dir), concepts(spark, sf_dir), 5).where("depth > 0")


@query(_closure_sql("dst>src", 3) + " SELECT * FROM c WHERE depth > 0")
def dependent_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(graph.reversed_edges(prerequisites(spark, sf_dir)), concepts(spark, sf_dir), 3).where("depth > 0")


@query(f"""{_WITH}, r AS (SELECT [CAST(99 AS BIGINT)] AS path UNION ALL SELECT list_append(path, dst) FROM r JOIN prerequisites ON src = path[-1] WHERE len(path) <= 6 AND NOT list_contains(path, dst))
SELECT array_to_string(path, '>') AS path, len(path) - 1 AS hops FROM r WHERE len(path) > 1""")
def concept_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.paths(prerequisites(spark, sf_dir), concepts(spark, sf_dir).where("node = 99"), 6)
    return found.select(F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"), (F.size("path") - 1).cast("long").alias("hops"))


@query(_REACH_SQL + """, proposed AS (SELECT node // 3 + 1 AS src, node AS dst FROM concepts)
SELECT p.src, p.dst, c.start IS NOT NULL AS is_cycle FROM proposed p LEFT JOIN c ON c.start = p.dst AND c.node = p.src""")
def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposed = concepts(spark, sf_dir).select((F.floor(F.col("node") / 3) + 1).alias("src"), F.col("node").alias("dst"))
    return graph.closes_cycle(prerequisites(spark, sf_dir), proposed)


@query(f"""{_WITH}, r AS (SELECT node, CAST(0 AS BIGINT) AS level FROM concepts UNION SELECT src, level + 1 FROM r JOIN prerequisites ON dst = node) SELECT node, max(level) AS level, false AS on_cycle FROM r GROUP BY 1""")
def concept_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges on the longest way down; the concepts of a cycle would share a level and be marked."""
    return graph.levels(prerequisites(spark, sf_dir), concepts(spark, sf_dir))


@query(f"""{_WITH}, e AS (SELECT src, dst FROM prerequisites UNION SELECT dst, src FROM prerequisites), r AS (SELECT CAST(77 AS BIGINT) AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM r JOIN e ON src = node WHERE distance < 12)
SELECT node, min(distance) AS distance FROM r GROUP BY 1""")
def shortest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.shortest(prerequisites(spark, sf_dir), 77, 12)


@query(f"""WITH {PREREQUISITES_SQL}, {CONCEPTS_SQL} SELECT node, (SELECT count(*) FROM prerequisites WHERE src = node) AS requires, (SELECT count(*) FROM prerequisites WHERE dst = node) AS required_by,
  (SELECT count(*) FROM prerequisites WHERE src = node AND strength = 'WEAK') AS weak FROM concepts""")
def concept_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = prerequisites(spark, sf_dir)
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("requires"), F.count(F.when(F.col("strength") == "WEAK", 1)).alias("weak"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("required_by"))
    rows = concepts(spark, sf_dir).join(out, "node", "left").join(into, "node", "left")
    return rows.select("node", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("requires", "required_by", "weak")))


def _next_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").select("doc_id", "source")
    # A book may hold most chunks: its sequence is numbered by ranges, and each chunk meets the next number.
    rows = ranks.numbered(chunks, "doc_id", "place", "source")
    return ranks.beside(rows, "place", 1, {"next_id": "doc_id"}, "source").where("next_id IS NOT NULL").select("doc_id", "source", "next_id")


_NEXT_SQL = "n AS (SELECT * FROM (SELECT doc_id, source, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS next_id FROM documents) WHERE next_id IS NOT NULL)"


@query(f"WITH {_NEXT_SQL} SELECT * FROM n")
def next_chunk_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_links(spark, sf_dir)


@query(f"WITH {_NEXT_SQL} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT next_id FROM n)")
def chain_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern absence as an anti join: chunks that no link leads to."""
    links = _next_links(spark, sf_dir).select(F.col("next_id").alias("doc_id"))
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(links, "doc_id", "left_anti")


@query("""WITH t AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS shared FROM t a JOIN t b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY 1, 2 HAVING count(*) >= 2""")
def co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts (suppliers) that share chunks (orders); a chunk has seven concepts at most, so that its pairs are few."""
    tags = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = tags.alias("a").join(tags.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") < F.col("b.l_suppkey")))
    return pairs.groupBy(F.col("a.l_suppkey").alias("a"), F.col("b.l_suppkey").alias("b")).agg(F.count("*").alias("shared")).where("shared >= 2")


@query(f"WITH {PREREQUISITES_SQL} SELECT strength AS kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM prerequisites GROUP BY 1")
def relation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prerequisites(spark, sf_dir).groupBy(F.col("strength").alias("kind")).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"), F.count_distinct("dst").alias("targets"))


@query(_REACH_SQL + f""", lv AS (SELECT node, CAST(0 AS BIGINT) AS level FROM concepts UNION SELECT p.src, lv.level + 1 FROM lv JOIN prerequisites p ON p.dst = lv.node), l AS (SELECT node, max(level) AS level FROM lv GROUP BY 1)
SELECT c.node, l.level, row_number() OVER (ORDER BY l.level, c.node) AS place, CAST(sum(5) OVER (ORDER BY l.level, c.node ROWS UNBOUNDED PRECEDING) AS BIGINT) AS minutes FROM c JOIN l ON l.node = c.node WHERE c.start = 99""")
def learning_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that one target needs, prerequisites first, five minutes each; one concept has few prerequisites, which one task can order."""
    edges = prerequisites(spark, sf_dir)
    needed = cut(graph.reachable(edges, concepts(spark, sf_dir).where("node = 99")).select("node"))
    # What a needed concept requires is needed as well: levels follow from these edges alone.
    needed = graph.levels(edges.join(needed.select(F.col("node").alias("src")), "src", "left_semi"), needed)
    place = F.row_number().over(Window.orderBy("level", "node")).cast("long")
    return needed.select("node", "level", place.alias("place"), (place * 5).alias("minutes"))
