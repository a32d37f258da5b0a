"""Writes of a content graph as tables: merged nodes and edges, guarded edges, mentions, similarity links, back-fill, deletes; and its exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import exports, graph, neighbours, upserts
from .projection import CONCEPTS_SQL, PREREQUISITES_SQL, concepts, prerequisites, read
from .registry import query


@query("""WITH n AS (SELECT DISTINCT source AS id FROM documents WHERE source IS NOT NULL), c AS (SELECT source, count(*) AS chunks, max(doc_id) AS newest FROM documents WHERE source IS NOT NULL GROUP BY 1)
SELECT 'book:' || id AS node, 'book' AS label, chunks AS size, newest FROM n JOIN c ON source = id UNION ALL SELECT 'chunk:' || doc_id, 'chunk', length(text), doc_id FROM documents WHERE text IS NOT NULL""")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of books and chunks, one for each id however often a batch names it: the newest wins."""
    docs = read(spark, sf_dir, "documents")
    size = docs.where("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("size"), F.max("doc_id").alias("newest"))
    books = size.select(F.concat(F.lit("book:"), "source").alias("node"), F.lit("book").alias("label"), "size", "newest")
    chunks = docs.where("text IS NOT NULL").select(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string")).alias("node"), F.lit("chunk").alias("label"), F.length("text").cast("long").alias("size"), F.col("doc_id").alias("newest"))
    return upserts.newest(books.unionByName(chunks).unionByName(chunks.where("newest % 3 = 0")), ["node", "label"], ["newest"]).select("node", "label", "size", "newest")


@query("""SELECT doc_id AS chunk, length(text) AS characters, len(string_split(text, ' ')) AS words, 'IN_BOOK' AS kind, source AS target FROM documents WHERE source IS NOT NULL AND text IS NOT NULL UNION ALL SELECT doc_id, length(text), len(string_split(text, ' ')), 'IN_LANGUAGE', lang FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL""")
def chunk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of chunks to what holds them, where it is known; words as the graph counts them, by single blanks."""
    docs = read(spark, sf_dir, "documents").where("text IS NOT NULL")
    ends = F.explode(F.array(F.struct(F.lit("IN_BOOK").alias("kind"), F.col("source").alias("target")), F.struct(F.lit("IN_LANGUAGE").alias("kind"), F.col("lang").alias("target"))))
    rows = docs.select(F.col("doc_id").alias("chunk"), F.length("text").cast("long").alias("characters"), F.size(F.split("text", " ")).cast("long").alias("words"), ends.alias("e"))
    return rows.select("chunk", "characters", "words", "e.kind", "e.target").where("target IS NOT NULL")


@query(f"""WITH RECURSIVE {CONCEPTS_SQL}, {PREREQUISITES_SQL}, r AS (SELECT node AS start, node FROM concepts WHERE node % 3 = 0 UNION SELECT r.start, p.dst FROM r JOIN prerequisites p ON p.src = r.node),
proposed AS (SELECT node // 4 AS src, node AS dst, node % 7 AS weight FROM concepts WHERE node % 3 = 0)
SELECT src, dst, CASE WHEN src = dst THEN 'self' WHEN EXISTS (SELECT 1 FROM r WHERE r.start = dst AND r.node = src) THEN 'cycle' WHEN weight = 0 THEN 'weight' ELSE 'ok' END AS outcome FROM proposed""")
def guarded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that may be added, and why others may not: to themselves, closing a cycle, without weight."""
    nodes = concepts(spark, sf_dir).where("node % 3 = 0")
    proposed = nodes.select(F.floor(F.col("node") / 4).alias("src"), F.col("node").alias("dst"))
    checked = graph.closes_cycle(prerequisites(spark, sf_dir), proposed)
    outcome = F.when(F.col("src") == F.col("dst"), "self").when(F.col("is_cycle"), "cycle").when(F.col("dst") % 7 == 0, "weight").otherwise("ok")
    return checked.select("src", "dst", outcome.alias("outcome"))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS chunk, l_partkey AS concept FROM lineitem), old AS (SELECT p_partkey AS concept, p_size AS references_before FROM part WHERE p_partkey % 2 = 0), n AS (SELECT concept, count(*) AS new FROM m GROUP BY 1)
SELECT coalesce(old.concept, n.concept) AS concept, coalesce(references_before, 0) + coalesce(new, 0) AS reference_count, references_before IS NULL AS created FROM old FULL JOIN n ON old.concept = n.concept""")
def concept_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts merged with a batch of mentions: counts go up, missing concepts are made."""
    mentions = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("concept")).distinct().groupBy("concept").agg(F.count("*").alias("new"))
    old = read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("concept"), F.col("p_size").alias("before"))
    rules = {"reference_count": F.coalesce("old.before", F.lit(0)) + F.coalesce("new.new", F.lit(0)), "created": F.col("old.before").isNull()}
    return upserts.accumulate(old, mentions, ["concept"], rules)


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT src, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS place FROM s) WHERE place <= 10 AND score >= 0.1""")
def similarity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of chunks to their ten nearest above a threshold, made anew for the chunks that changed."""
    rows = read(spark, sf_dir, "embeddings")
    found = neighbours.batch_nearest(rows, rows.where("vec_id % 50 = 0"), "vec_id", "embedding", 10)
    return found.where("score >= 0.1").select(F.col("query_id").alias("src"), F.col("id").alias("dst"), "score")


@query("""WITH lacking AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 10 <> 0)) SELECT doc_id, CASE WHEN doc_id IN (SELECT vec_id FROM embeddings) THEN 'renewed' ELSE 'missing' END AS state FROM lacking""")
def embedding_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that lack a vector, and which of them a new batch brings: a join each, no reading one by one."""
    docs, vectors = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    lacking = docs.join(vectors.where("doc_id % 10 <> 0"), "doc_id", "left_anti")
    return lacking.join(vectors.withColumn("hit", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("hit"), "renewed").otherwise("missing").alias("state"))


@query(f"""WITH RECURSIVE {CONCEPTS_SQL}, {PREREQUISITES_SQL}, r AS (SELECT CAST(5 AS BIGINT) AS node UNION SELECT p.src FROM r JOIN prerequisites p ON p.dst = r.node) SELECT src, dst, strength FROM prerequisites WHERE src NOT IN (FROM r) AND dst NOT IN (FROM r)""")
def without_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that stay when a concept goes with all that builds on it."""
    edges = prerequisites(spark, sf_dir)
    gone = graph.reachable(graph.reversed_edges(edges), concepts(spark, sf_dir).where("node = 5")).select("node")
    stays = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti")
    return stays.join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "strength")


@query("""SELECT o_orderkey AS ticket, sha256(o_orderkey || ':' || o_orderstatus) AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS sequence, coalesce(n, 0) AS fields FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def batch_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch with ids that follow from their contents, the number in their path, and the number of dependent rows."""
    fields = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    rows = read(spark, sf_dir, "orders").withColumn("sequence", place).join(fields, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("ticket"), F.sha2(F.concat_ws(":", "o_orderkey", "o_orderstatus"), 256).alias("id"), "sequence", F.coalesce("n", F.lit(0)).alias("fields"))


@query("SELECT c_custkey AS id, c_name AS name, round(c_acctbal, 2) AS balance, c_mktsegment AS segment FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV with a header, one file for each task, and read back."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"), F.col("c_mktsegment").alias("segment"))
    return exports.csv(rows)


@query("SELECT vec_id AS id, label, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x)), 4) AS total FROM embeddings")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as lines of JSON and read back."""
    rows = exports.json(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("e")))
    return rows.select("id", "label", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(f"""WITH {CONCEPTS_SQL}, {PREREQUISITES_SQL}, n AS (SELECT p_partkey AS node, '  "' || p_partkey || '" [label="' || p_name || '", fillcolor="' || CASE p_size % 3 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' ELSE 'white' END || '"];' AS line FROM part),
e AS (SELECT src AS node, '  "' || dst || '" -> "' || src || '"' || CASE strength WHEN 'WEAK' THEN ' [style=dashed]' ELSE '' END || ';' AS line FROM prerequisites) SELECT node, line FROM n UNION ALL SELECT node, line FROM e""")
def graph_drawing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a drawing of all concepts, coloured by status, in the DOT language."""
    size = F.col("p_size") % 3
    nodes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_name").alias("label"), F.when(size == 0, "green").when(size == 1, "yellow").otherwise("white").alias("colour"))
    edges = prerequisites(spark, sf_dir).select(F.col("dst").alias("tail"), F.col("src").alias("head"), (F.col("strength") == "WEAK").alias("dashed"))
    return exports.dot_lines(nodes, edges)


@query(f"""WITH RECURSIVE {CONCEPTS_SQL}, {PREREQUISITES_SQL}, e AS (SELECT src, dst FROM prerequisites UNION SELECT dst, src FROM prerequisites), r AS (SELECT node AS a, node AS b, 0 AS d FROM concepts WHERE node < 20 UNION SELECT r.a, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.b WHERE r.d < 4), m AS (SELECT a, b, min(d) AS d FROM r GROUP BY 1, 2),
t AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS k FROM lineitem), s AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM t x JOIN t y ON x.c = y.c AND x.k <> y.k WHERE x.k < 20 GROUP BY 1, 2), st AS (SELECT DISTINCT src, dst FROM prerequisites WHERE strength = 'STRONG')
SELECT m.a, m.b, m.d AS distance, coalesce(shared, 0) AS shared, round(least(1.0, 1 / (1 + m.d) * CASE WHEN EXISTS (SELECT 1 FROM st WHERE (src = m.a AND dst = m.b) OR (src = m.b AND dst = m.a)) THEN 1.2 ELSE 1 END * (1 + least(0.5, 0.1 * coalesce(shared, 0)))), 6) AS similarity FROM m LEFT JOIN s ON s.a = m.a AND s.b = m.b WHERE m.d > 0""")
def concept_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts within four hops of the first twenty: nearness, more for a strong edge and for chunks that name both."""
    edges = prerequisites(spark, sf_dir)
    near = graph.reach(graph.undirected(edges), concepts(spark, sf_dir).where("node < 20"), 4).where("depth > 0").select(F.col("start").alias("a"), F.col("node").alias("b"), F.col("depth").alias("distance"))
    tags = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("c"), F.col("l_partkey").alias("a")).distinct()
    both = tags.where("a < 20").join(tags.withColumnRenamed("a", "b"), "c").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    strong = edges.where("strength = 'STRONG'").select("src", "dst").distinct()
    strong = graph.undirected(strong).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("strong"))
    rows = near.join(both, ["a", "b"], "left").join(strong, ["a", "b"], "left")
    shared = F.coalesce("shared", F.lit(0))
    score = 1 / (1 + F.col("distance")) * F.when(F.col("strong"), 1.2).otherwise(1.0) * (1 + F.least(F.lit(0.5), 0.1 * shared))
    return rows.select("a", "b", F.col("distance"), shared.alias("shared"), F.round(F.least(F.lit(1.0), score), 6).alias("similarity"))


@query(f"""WITH RECURSIVE {CONCEPTS_SQL}, {PREREQUISITES_SQL}, e AS (SELECT src, dst FROM prerequisites UNION SELECT dst, src FROM prerequisites), st AS (SELECT src, dst FROM prerequisites WHERE strength = 'STRONG' UNION SELECT dst, src FROM prerequisites WHERE strength = 'STRONG'),
g AS (SELECT src AS k, count(*) AS degree FROM e GROUP BY 1), seeds AS (SELECT k FROM g WHERE NOT EXISTS (SELECT 1 FROM e JOIN g o ON o.k = e.dst WHERE e.src = g.k AND (o.degree > g.degree OR o.degree = g.degree AND o.k < g.k))),
w AS (SELECT src AS seed, dst AS other, 1 AS d FROM e SEMI JOIN seeds ON k = src UNION ALL SELECT a.src, b.dst, 2 FROM e a SEMI JOIN seeds ON k = a.src JOIN e b ON b.src = a.dst AND b.dst <> a.src),
cand AS (SELECT seed, other, min(d) AS d, count(*) AS ways FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY count(*) DESC, other) <= 20), t AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS k FROM lineitem),
s AS (SELECT seed, other, count(*) AS shared FROM cand JOIN t x ON x.k = seed JOIN t y ON y.k = other AND x.c = y.c GROUP BY 1, 2), p AS (SELECT cand.seed, cand.other FROM cand LEFT JOIN s ON s.seed = cand.seed AND s.other = cand.other LEFT JOIN st ON src = cand.seed AND dst = cand.other
  WHERE round(least(1.0, 1 / (1 + d) * CASE WHEN src IS NULL THEN 1 ELSE 1.2 END * (1 + least(0.5, 0.1 * coalesce(shared, 0)))), 6) >= 0.6), b AS (SELECT seed AS x, other AS y FROM p UNION SELECT other, seed FROM p),
r AS (SELECT DISTINCT x AS k, x AS other FROM b UNION SELECT r.k, b.y FROM r JOIN b ON b.x = r.other) SELECT k AS concept, min(other) AS cluster FROM r GROUP BY 1""")
def concept_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts around the best-linked ones: of the twenty with most ways of one or two edges, those similar enough; clusters that meet are one."""
    edges = prerequisites(spark, sf_dir)
    tags = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col("l_partkey").alias("concept")).distinct()
    return graph.clusters(edges, tags).select(F.col("node").alias("concept"), F.col("component").alias("cluster"))
