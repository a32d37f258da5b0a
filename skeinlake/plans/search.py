"""Queries of a learner's search: four fused lists, enrichment, re-ranking, words about results, comparison of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import relevance as R
from ..operators import neighbours
from ..operators.lineage import cut
from .graphs import _next_links
from .projection import read
from .registry import query
from .vector_search import _query_vector

#: What a learner brings to the search: where they are, and what they have read.
CURRENT, HISTORY, LIMIT = 7, [3, 11, 26, 40], 40
#: The vectors at hand are random: no least similarity.
LEAST = -1.0


def _world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks (with a section and a chapter), mentions of concepts, and steps from a chunk to the next one of its book."""
    chunks = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("section"), (F.col("label") % 3).alias("chapter"))
    mentions = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_partkey") % 50).alias("concept")).distinct().join(chunks.select("id"), "id", "left_semi")
    steps = _next_links(spark, sf_dir).select(F.col("doc_id").alias("src"), F.col("next_id").alias("dst"))
    return chunks, mentions, steps


_WORLD_SQL = """w AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label AS section, label % 3 AS chapter FROM embeddings), q AS (SELECT vector AS qv FROM w WHERE id = 0),
sims AS (SELECT id, section, chapter, round(list_cosine_similarity(vector, qv), 6) AS score FROM w, q), mentions AS (SELECT DISTINCT l_orderkey AS id, l_partkey % 50 AS concept FROM lineitem WHERE l_orderkey IN (SELECT id FROM w)),
steps AS (SELECT * FROM (SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS dst FROM documents) WHERE dst IS NOT NULL),
sem AS (SELECT id, score FROM sims ORDER BY score DESC, id LIMIT 40), half AS (SELECT id, score FROM sims ORDER BY score DESC, id LIMIT 20), own AS (SELECT section AS s, chapter AS c FROM w WHERE id = 7),
ctx AS (SELECT sem.id, round(least(1.0, sem.score * CASE WHEN section = s THEN 1.3 WHEN chapter = c THEN 1.15 ELSE 1.0 END), 6) AS score FROM sem JOIN w USING (id), own),
cons AS (SELECT DISTINCT concept FROM mentions WHERE id IN (SELECT id FROM half ORDER BY score DESC, id LIMIT 5)),
conf AS (SELECT id, count(DISTINCT concept) AS n FROM mentions WHERE concept IN (FROM cons) AND id NOT IN (SELECT id FROM half) GROUP BY 1 HAVING count(DISTINCT concept) >= 2 ORDER BY n DESC, id LIMIT 20),
con AS (SELECT * FROM half UNION ALL SELECT id, round(least(1.0, list_cosine_similarity(vector, qv) * (1 + 0.1 * n)), 6) FROM conf JOIN w USING (id), q),
s1 AS (SELECT src AS learned, dst AS id FROM steps WHERE src IN (3, 11, 26, 40)), s2 AS (SELECT DISTINCT learned, dst AS id FROM s1 JOIN steps ON src = id), s3 AS (SELECT DISTINCT learned, dst AS id FROM s2 JOIN steps ON src = id),
found AS (SELECT id, count(DISTINCT learned) AS n FROM (FROM s1 UNION ALL FROM s2 UNION ALL FROM s3) WHERE id NOT IN (3, 11, 26, 40) AND id NOT IN (SELECT id FROM half) GROUP BY 1 ORDER BY n DESC, id LIMIT 20),
lp AS (SELECT * FROM half UNION ALL SELECT id, round(least(1.0, list_cosine_similarity(vector, qv) * 1.2), 6) FROM found JOIN w USING (id), q),
every AS (SELECT *, 0.4 AS wt FROM sem UNION ALL SELECT *, 0.2 FROM ctx UNION ALL SELECT *, 0.3 FROM con UNION ALL SELECT *, 0.1 FROM lp),
fused AS (SELECT id, round(sum(score * wt) / sum(wt), 6) AS score, count(*) AS lists FROM every GROUP BY 1)"""


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, mentions, steps = _world(spark, sf_dir)
    return neighbours.hybrid(chunks, mentions, steps, _query_vector(spark, sf_dir), LIMIT, CURRENT, HISTORY, LEAST)


@query(f"WITH {_WORLD_SQL} SELECT id, round(score, 5) AS score, lists FROM fused")
def learner_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic, contextual, conceptual and path lists, fused by their weights."""
    return _fused(spark, sf_dir).withColumn("score", F.round("score", 5))


_ENRICHED = """enr AS (SELECT f.id, f.score, lists, section, chapter, source AS book, list_sort(list(DISTINCT concept) FILTER (concept IS NOT NULL)) AS concepts, CASE id % 4 WHEN 0 THEN 'definition' WHEN 1 THEN 'example' WHEN 2 THEN 'exercise' ELSE 'text' END AS kind, (id % 11) / 10 AS difficulty,
  CASE WHEN id >= 2 THEN list_sort(list_distinct([id // 2, id // 3])) ELSE [] END AS prerequisites FROM fused f JOIN w USING (id) LEFT JOIN documents ON doc_id = id LEFT JOIN mentions USING (id) GROUP BY ALL)"""


def _enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with book, section and chapter, their concepts, kind, difficulty and prerequisites."""
    chunks, mentions, _ = _world(spark, sf_dir)
    k = F.col("id")
    of_chunk = mentions.groupBy("id").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    books = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book"))
    rows = _fused(spark, sf_dir).join(chunks.select("id", "section", "chapter"), "id").join(books, "id", "left").join(of_chunk, "id", "left")
    kind = F.when(k % 4 == 0, "definition").when(k % 4 == 1, "example").when(k % 4 == 2, "exercise").otherwise("text")
    needs = F.when(k >= 2, F.array_sort(F.array_distinct(F.array(F.floor(k / 2), F.floor(k / 3))))).otherwise(F.array().cast("array<bigint>"))
    return rows.withColumns({"concepts": F.coalesce("concepts", F.array().cast("array<bigint>")), "kind": kind, "difficulty": k % 11 / 10, "prerequisites": needs})


_DIFFICULTY = "CASE WHEN difficulty BETWEEN 0.3 AND 0.7 THEN 1 - abs(difficulty - 0.5) / 0.2 WHEN difficulty < 0.3 THEN greatest(0.0, 1 - (0.3 - difficulty) * 2) ELSE greatest(0.0, 1 - (difficulty - 0.7) * 2) END"
_RANKED = f"""rk AS (SELECT *, CASE WHEN len(prerequisites) = 0 THEN 1.0 ELSE len(list_intersect(prerequisites, [3, 11, 26, 40])) / len(prerequisites) END AS met, {_DIFFICULTY} AS fit, CASE WHEN kind IN ('exercise', 'problem') THEN 1.0 ELSE 0.3 END AS intent,
  CASE WHEN len(list_intersect(coalesce(concepts, []), [5, 8, 13])) > 0 THEN len(list_intersect(concepts, [5, 8, 13])) / 3 END AS related FROM enr), res AS (SELECT *, least(1.0, score * (1 + (0.3 * met + 0.3 * fit + 0.4 * intent) * 0.5)) AS rank FROM rk)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    rows = _enriched(spark, sf_dir).withColumns({"met": R.prerequisite_score(F.col("prerequisites"), longs(HISTORY)), "fit": R.difficulty_match(F.col("difficulty"), "intermediate"), "intent": R.intent_match(F.col("kind"), "practice"), "related": R.related_share(F.col("concepts"), longs([5, 8, 13]))})
    return rows.withColumn("rank", R.reranked(F.col("score"), F.col("met"), F.col("fit"), F.col("intent")))


@query(f"WITH {_WORLD_SQL}, {_ENRICHED} SELECT id, section, chapter, book, array_to_string(coalesce(concepts, []), ',') AS concepts, array_to_string(prerequisites, ',') AS prerequisites FROM enr")
def enriched_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _enriched(spark, sf_dir).select("id", "section", "chapter", "book", text("concepts"), text("prerequisites"))


@query(f"""WITH {_WORLD_SQL}, {_ENRICHED}, {_RANKED} SELECT id, round(met, 5) AS met, round(fit, 5) AS fit, intent::DOUBLE AS intent, round(related, 5) AS related, round(rank, 5) AS rank, concat_ws(',', 'semantic', CASE WHEN related IS NOT NULL THEN 'related_concept' END, CASE WHEN len(prerequisites) > 0 THEN 'prerequisite' END) AS types,
  coalesce(nullif(concat_ws('; ', CASE WHEN score > 0.9 THEN 'Very high semantic similarity' WHEN score > 0.8 THEN 'High semantic similarity' WHEN score > 0.7 THEN 'Good semantic similarity' END, CASE WHEN related IS NOT NULL THEN 'Related concepts: ' || array_to_string(concepts[1:3], ', ') END,
  CASE WHEN len(prerequisites) > 0 THEN 'Contains prerequisite information' END), ''), 'Relevant content') AS explanation FROM res ORDER BY rank DESC, id LIMIT 20""")
def reranked_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results after the boosts for prerequisites, difficulty and intent, with the types of relevance and words about them."""
    types = F.concat_ws(",", F.lit("semantic"), F.when(F.col("related").isNotNull(), "related_concept"), F.when(F.size("prerequisites") > 0, "prerequisite"))
    why = R.explanation(F.col("score"), F.col("related"), F.col("concepts"), F.col("prerequisites"))
    five = [F.round(c, 5).alias(c) for c in ("met", "fit", "intent", "related", "rank")]
    return _ranked(spark, sf_dir).orderBy(F.desc("rank"), "id").limit(20).select("id", *five, types.alias("types"), why.alias("explanation"))


@query(f"""WITH {_WORLD_SQL}, {_ENRICHED}, {_RANKED}, r AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY rank DESC, id) AS place FROM res) WHERE place <= 20),
c AS (SELECT string_agg(c, ', ' ORDER BY c) AS names FROM (SELECT DISTINCT unnest(concepts[1:2]) AS c FROM r WHERE place <= 5 ORDER BY c LIMIT 3)), t AS (SELECT count(*) AS n, avg(difficulty) FILTER (place <= 10) AS d FROM r)
SELECT suggestion FROM (SELECT 'Try related concepts for more results' AS suggestion FROM t WHERE n BETWEEN 1 AND 4 UNION ALL SELECT 'Try broadening your search criteria' FROM t WHERE n = 0 UNION ALL SELECT 'Related concepts: ' || names FROM c WHERE names IS NOT NULL UNION ALL SELECT 'Consider searching for introductory content' FROM t WHERE d > 0.4)""")
def search_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to search next, from the first twenty results."""
    w = Window.orderBy(F.desc("rank"), "id")
    top = _ranked(spark, sf_dir).orderBy(F.desc("rank"), "id").limit(20).withColumn("place", F.row_number().over(w))
    names = top.where("place <= 5").select(F.explode(F.slice("concepts", 1, 2)).alias("c")).distinct().orderBy("c").limit(3).agg(F.array_join(F.array_sort(F.collect_list("c")).cast("array<string>"), ", ").alias("names"))
    facts = top.agg(F.count("*").alias("n"), F.avg(F.when(F.col("place") <= 10, F.col("difficulty"))).alias("d"))
    told = F.array(F.when(F.col("n") == 0, "Try broadening your search criteria").when(F.col("n") < 5, "Try related concepts for more results"), F.when(F.col("names") != "", F.concat(F.lit("Related concepts: "), "names")), F.when(F.col("d") > 0.4, "Consider searching for introductory content"))
    return facts.crossJoin(names).select(F.explode(F.array_compact(told)).alias("suggestion"))  # one row each


@query(f"""WITH {_WORLD_SQL}, a AS (SELECT id, score FROM sem), b AS (SELECT id, score FROM con), j AS (SELECT a.id AS x, b.id AS y, a.score AS sa, b.score AS sb FROM a FULL JOIN b ON a.id = b.id)
SELECT count(x) AS first, count(y) AS second, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS common, round(count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) / count(*), 5) AS overlap, round(avg(sa), 5) AS first_mean, round(avg(sb), 5) AS second_mean FROM j""")
def search_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two searches for one question: sizes, common results and mean scores."""
    chunks, mentions, _ = _world(spark, sf_dir)
    vector = _query_vector(spark, sf_dir)
    a = neighbours.nearest(chunks, vector, "id", "vector", LIMIT, LEAST).select(F.col("id").alias("x"), F.col("score").alias("sa"))
    b = neighbours.conceptual(chunks, mentions, vector, LIMIT, LEAST).select(F.col("id").alias("y"), F.col("score").alias("sb"))
    both = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1))
    return a.join(b, F.col("x") == F.col("y"), "full").agg(F.count("x").alias("first"), F.count("y").alias("second"), both.alias("common"), F.round(both / F.count("*"), 5).alias("overlap"), F.round(F.avg("sa"), 5).alias("first_mean"), F.round(F.avg("sb"), 5).alias("second_mean"))


_CHAIN = """WITH RECURSIVE p AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey >= 2 UNION ALL SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 4 AND p_size % 3 = 0), r AS (SELECT CAST(99 AS BIGINT) AS node, 0 AS depth UNION SELECT p.dst, depth + 1 FROM r JOIN p ON p.src = r.node WHERE depth < 3)"""


@query(f"""{_CHAIN}, c AS (SELECT l_orderkey AS chunk, min(depth) AS path_length, count(DISTINCT node) AS concepts FROM r JOIN lineitem ON l_partkey = node WHERE depth > 0 GROUP BY 1) SELECT chunk, path_length, concepts FROM c ORDER BY path_length, concepts DESC, chunk LIMIT 20""")
def prerequisite_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that name what a concept requires, those on the shortest way first."""
    from ..operators import graph
    from .projection import concepts, prerequisites

    needed = graph.reach(prerequisites(spark, sf_dir), concepts(spark, sf_dir).where("node = 99"), 3).where("depth > 0").groupBy(F.col("node").alias("l_partkey")).agg(F.min("depth").alias("depth"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chunk"), "l_partkey").distinct().join(needed, "l_partkey")
    return rows.groupBy("chunk").agg(F.min("depth").alias("path_length"), F.count("*").alias("concepts")).orderBy("path_length", F.desc("concepts"), "chunk").limit(20)


@query(f"WITH {_WORLD_SQL} SELECT id AS chunk, count(DISTINCT learned) AS precedents FROM (FROM s1 UNION ALL FROM s2 UNION ALL FROM s3) WHERE id NOT IN (3, 11, 26, 40) GROUP BY 1")
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks one to three steps after what was read, with how many of the read ones lead to each."""
    _, _, steps = _world(spark, sf_dir)
    reached = steps.where(F.col("src").isin(HISTORY)).select(F.col("src").alias("learned"), F.col("dst").alias("chunk"))
    every = reached
    for _ in range(2):
        reached = reached.join(steps, F.col("chunk") == F.col("src")).select("learned", F.col("dst").alias("chunk")).distinct()
        every = every.unionByName(reached)
    return every.where(~F.col("chunk").isin(HISTORY)).groupBy("chunk").agg(F.count_distinct("learned").alias("precedents"))


@query("SELECT source AS book, count(*) - 1 AS chain_length, min(doc_id) AS first_chunk, max(doc_id) AS last_chunk FROM documents WHERE source IS NOT NULL GROUP BY 1")
def chain_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many links lead from the first chunk of a book to its last: pointers walk them and double their reach each round."""
    from ..operators import graph

    steps = cut(_next_links(spark, sf_dir).where("source IS NOT NULL"))
    links, _ = graph.contracted(steps.select(F.col("doc_id").alias("src"), F.col("next_id").alias("dst")))
    books = read(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.col("source").alias("book"), F.col("doc_id").alias("src"))
    # Chunks that no step leads to begin a chain; without a step of their own, it has no link.
    heads = books.join(steps.select(F.col("next_id").alias("src")).hint("merge"), "src", "left_anti").join(links.hint("merge"), "src", "left")
    return heads.select("book", F.coalesce("length", F.lit(0)).alias("chain_length"), F.col("src").alias("first_chunk"), F.coalesce("dst", "src").alias("last_chunk"))


@query(f"""WITH {_WORLD_SQL}, v AS (SELECT id, score, 'vector' AS mode FROM sims WHERE score >= 0.7), t AS (SELECT doc_id AS id, round(len(regexp_extract_all(lower(text), ' nicht[ ,.]')) / 10, 6) AS score, 'text' AS mode FROM documents WHERE regexp_matches(lower(text), ' nicht[ ,.]') AND (SELECT count(*) FROM v) < 5)
SELECT * FROM v UNION ALL SELECT * FROM (FROM t ORDER BY score DESC, id LIMIT 20)""")
def concept_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts near a vector; where there are hardly any, texts that hold the word as well, marked by how they were found."""
    chunks, _, _ = _world(spark, sf_dir)
    near = neighbours.within(chunks, _query_vector(spark, sf_dir), "id", "vector", 0.7).withColumn("mode", F.lit("vector"))
    few = near.agg((F.count("*") < 5).alias("few"))  # one row
    uses = F.regexp_count(F.lower("text"), F.lit(" nicht[ ,.]"))
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.round(uses / 10, 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(20)
    return near.unionByName(texts.join(F.broadcast(few)).where("few").select("id", "score", F.lit("text").alias("mode")))


@query(f"WITH {_WORLD_SQL} SELECT f.id AS chunk, round(score, 5) AS score, o_orderpriority AS path, o_orderstatus AS status, c_name AS owner FROM (FROM fused ORDER BY score DESC, id LIMIT 10) f JOIN orders ON o_orderkey = f.id JOIN customer ON c_custkey = o_custkey")
def search_to_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best results as tickets of a path, with their owners."""
    top = _fused(spark, sf_dir).orderBy(F.desc("score"), "id").limit(10)
    tickets = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return top.join(tickets, F.col("id") == F.col("o_orderkey")).select(F.col("id").alias("chunk"), F.round("score", 5).alias("score"), F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("status"), F.col("c_name").alias("owner"))


@query("SELECT o_orderkey AS ticket, o_orderstatus AS status FROM orders WHERE (NULL IS NULL OR o_custkey = NULL) AND ('O' IS NULL OR o_orderstatus = 'O') AND o_orderkey BETWEEN 100 AND 900")
def tickets_by_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters that may be absent: a filter is only there for those that are given."""
    given = {"o_custkey": None, "o_orderstatus": "O"}
    rows = read(spark, sf_dir, "orders").where("o_orderkey BETWEEN 100 AND 900")
    for column, value in given.items():
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows.select(F.col("o_orderkey").alias("ticket"), F.col("o_orderstatus").alias("status"))
