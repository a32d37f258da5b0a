"""Queries of results with their chains, views and counts of graphs, page ranges, labels, normal forms, rounding and times as text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, neighbours, ranks
from .projection import CONCEPTS_SQL, PREREQUISITES_SQL, concepts, prerequisites, read
from .registry import query
from .vector_search import _QUERY_SQL, _query_vector

_HOPS = lambda name, a, b: f"{name} AS (SELECT id AS start, id AS node, 0 AS depth FROM hits UNION SELECT r.start, p.{b}, r.depth + 1 FROM {name} r JOIN prerequisites p ON p.{a} = r.node WHERE r.depth < 3)"


@query(f"""WITH RECURSIVE {_QUERY_SQL.removeprefix('WITH ')}, {PREREQUISITES_SQL}, hits AS (SELECT vec_id AS id, score FROM s ORDER BY score DESC, vec_id LIMIT 10), {_HOPS('up', 'src', 'dst')}, {_HOPS('down', 'dst', 'src')},
u AS (SELECT start, string_agg(node || ':' || depth, ',' ORDER BY depth, node) AS chain FROM (SELECT start, node, min(depth) AS depth FROM up WHERE node <> start GROUP BY 1, 2) GROUP BY 1), d AS (SELECT start, string_agg(node || ':' || depth, ',' ORDER BY depth, node) AS chain FROM (SELECT start, node, min(depth) AS depth FROM down WHERE node <> start GROUP BY 1, 2) GROUP BY 1)
SELECT id, score, coalesce(u.chain, '') AS prerequisites, coalesce(d.chain, '') AS dependents FROM hits LEFT JOIN u ON u.start = id LEFT JOIN d ON d.start = id""")
def expanded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest chunks, each with what its concept requires and what builds on it, up to three edges away."""
    hits = neighbours.nearest(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), "vec_id", "embedding", 10).withColumnRenamed("vec_id", "id")
    edges, starts = prerequisites(spark, sf_dir), hits.select(F.col("id").alias("node"))

    def chain(edges: DataFrame, name: str) -> DataFrame:
        found = graph.reach(edges, starts, 3).where("node <> start")
        steps = F.array_sort(F.collect_list(F.struct("depth", "node")))
        return found.groupBy(F.col("start").alias("id")).agg(F.array_join(F.transform(steps, lambda s: F.concat_ws(":", s["node"].cast("string"), s["depth"].cast("string"))), ",").alias(name))

    rows = hits.join(chain(edges, "prerequisites"), "id", "left").join(chain(graph.reversed_edges(edges), "dependents"), "id", "left")
    return rows.select("id", "score", *(F.coalesce(c, F.lit("")).alias(c) for c in ("prerequisites", "dependents")))


@query(f"""WITH {CONCEPTS_SQL}, {PREREQUISITES_SQL}, e AS (SELECT src, dst FROM prerequisites UNION SELECT dst, src FROM prerequisites), w AS (SELECT src, dst FROM e UNION SELECT a.src, b.dst FROM e a JOIN e b ON b.src = a.dst)
SELECT node, count(DISTINCT dst) FILTER (dst <> node) AS related FROM concepts LEFT JOIN w ON src = node GROUP BY 1""")
def related_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other concepts lie within two edges of each, whatever their direction."""
    both = graph.undirected(prerequisites(spark, sf_dir))
    two = both.join(both.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
    near = both.select("src", "dst").unionByName(two).where("src <> dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count("*").alias("related"))
    return concepts(spark, sf_dir).join(near, "node", "left").select("node", F.coalesce("related", F.lit(0)).alias("related"))


@query(f"WITH {PREREQUISITES_SQL} SELECT src, a.p_name AS concept, dst, b.p_name AS prerequisite, strength, b.p_partkey IS NOT NULL AS known FROM prerequisites JOIN part a ON a.p_partkey = src LEFT JOIN part b ON b.p_partkey = dst")
def prerequisite_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge with the names of both ends, also where the prerequisite is no concept of the table."""
    names = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = prerequisites(spark, sf_dir).join(names.select(F.col("p_partkey").alias("src"), F.col("p_name").alias("concept")), "src")
    rows = rows.join(names.select(F.col("p_partkey").alias("dst"), F.col("p_name").alias("prerequisite"), F.lit(True).alias("hit")), "dst", "left")
    return rows.select("src", "concept", "dst", "prerequisite", "strength", F.coalesce("hit", F.lit(False)).alias("known"))


@query("""WITH n AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents WHERE text IS NOT NULL), r AS (SELECT source, (page - 1) // 5 AS section, string_agg(text, chr(10) ORDER BY page) AS text, min(page) AS first_page, max(page) AS last_page FROM n GROUP BY 1, 2)
SELECT source, section, first_page, last_page, length(text) AS characters, md5(text) AS digest FROM r""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of every five pages of a book in a row, joined: a book with most pages is numbered in ranges, and no task holds more than five."""
    pages = ranks.numbered(read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "source", "text"), "doc_id", "page", "source")
    rows = pages.groupBy("source", F.floor((F.col("page") - 1) / 5).alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("t"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    return rows.select("source", "section", "first_page", "last_page", F.length("t").cast("long").alias("characters"), F.md5("t").alias("digest"))


def wrapped(label: Column, width: int = 30) -> Column:
    """Words in lines of at most `width` characters where a word fits; a longer word has a line of its own.  A first line that stays empty is kept, as drawings have it."""
    words = F.filter(F.split(label, r"\s+"), lambda w: w != "")
    begin = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("line"))

    def put(held: Column, word: Column) -> Column:
        line = F.when(held["line"].isNull(), word).otherwise(F.concat(held["line"], F.lit(" "), word))
        full = F.length(line) > width
        return F.struct(F.when(full, F.concat(held["lines"], F.array(F.coalesce(held["line"], F.lit(""))))).otherwise(held["lines"]).alias("lines"), F.when(full, word).otherwise(line).alias("line"))

    return F.aggregate(words, begin, put, lambda held: F.array_join(F.concat(held["lines"], F.array_compact(F.array(held["line"]))), "\\n"))


@query(r"""WITH RECURSIVE w AS (SELECT p_partkey AS concept, list_filter(string_split_regex(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name, '\s+'), lambda x: x <> '') AS ws FROM part),
r AS (SELECT concept, ws, 0 AS i, CAST([] AS VARCHAR[]) AS lines, CAST(NULL AS VARCHAR) AS line FROM w UNION ALL
  SELECT concept, ws, i + 1, CASE WHEN length(concat_ws(' ', line, ws[i + 1])) > 30 THEN list_append(lines, coalesce(line, '')) ELSE lines END, CASE WHEN length(concat_ws(' ', line, ws[i + 1])) > 30 THEN ws[i + 1] ELSE concat_ws(' ', line, ws[i + 1]) END FROM r WHERE i < len(ws))
SELECT concept, array_to_string(CASE WHEN line IS NULL THEN lines ELSE list_append(lines, line) END, '\n') AS label FROM r WHERE i = len(ws)""")
def wrapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of concepts for a drawing, in lines of thirty characters: a fold over the words."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept"), wrapped(F.concat_ws(" ", "p_name", "p_type", "p_brand", "p_name")).alias("label"))


def normal_form(rows: DataFrame, keys: list[str], text_col: str, form: str = "NFKC") -> DataFrame:
    """keys and text, whose characters have their compatible composed form; quotes, dashes, dots and blanks become plain ones first."""
    kinds = dict(rows.dtypes)
    mapped = F.replace(F.translate(text_col, "‘’“”–— ", "''\"\"-- "), F.lit("…"), F.lit("..."))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Arrow's own kernel leaves some long texts decomposed.
            texts = [t and unicodedata.normalize(form, t) for t in batch.columns[-1].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=batch.schema.names)

    return rows.select(*keys, mapped.alias(text_col)).mapInArrow(task, ", ".join(f"{c} {kinds[c]}" for c in (*keys, text_col)))


@query()
def normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in Unicode's compatible composed form."""
    return normal_form(read(spark, sf_dir, "documents"), ["doc_id"], "text")


@query("SELECT event_id, round_even(event_id / 8, 2) AS eighths, round_even(event_id / 4, 0) AS quarters, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, CAST(date_trunc('day', ts) AS DATE) AS day FROM events")
def rounded_and_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers rounded to the even neighbour where two are as near, and times in ISO form."""
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select("event_id", F.bround(k / 8, 2).alias("eighths"), F.bround(k / 4, 0).alias("quarters"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.to_date("ts").alias("day"))
