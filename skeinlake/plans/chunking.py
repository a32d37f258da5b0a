"""Queries that cut books into chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prose as P
from ..operators import chunking, concepts
from .projection import read
from .registry import query, typed
from .structure import BOOKS_SQL, ELEMENTS_SQL, books


def _rows(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, "chunk_no", "begin", "finish", F.length("chunk").cast("long").alias("characters"), F.md5("chunk").alias("digest"))


#: Texts with blank lines: every third line feed is doubled by its position in the line before.
_PARAGRAPHS = "regexp_replace(text, '([.!?]) ([A-Z])', '\\1' || chr(10) || chr(10) || '\\2', 'g')"


@query(typed(f"""WITH RECURSIVE t AS (SELECT doc_id, trim({_PARAGRAPHS}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS ps, text FROM t WHERE text <> ''),
r AS (SELECT doc_id, 1 AS i, 0 AS chunk, length(ps[1]) AS size FROM p WHERE length(text) > 1500 UNION ALL
  SELECT r.doc_id, i + 1, chunk + CASE WHEN size + length(ps[i + 1]) + 2 > 1500 THEN 1 ELSE 0 END, CASE WHEN size + length(ps[i + 1]) + 2 > 1500 THEN length(ps[i + 1]) ELSE size + length(ps[i + 1]) + 2 END FROM r JOIN p USING (doc_id) WHERE i < len(ps))
SELECT doc_id, chunk AS chunk_no, min(i) - 1 AS "begin", max(i) AS finish, length(string_agg(ps[i], chr(10) || chr(10) ORDER BY i)) AS characters, md5(string_agg(ps[i], chr(10) || chr(10) ORDER BY i)) AS digest FROM r JOIN p USING (doc_id) GROUP BY 1, 2
UNION ALL SELECT doc_id, 0, 0, 1, length(text), md5(text) FROM p WHERE length(text) <= 1500""", chunk_no="BIGINT", finish="BIGINT", **{'"begin"': "BIGINT"}))
def greedy_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed in order into chunks of at most 1500 characters."""
    rows = read(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_replace("text", "([.!?]) ([A-Z])", "$1\n\n$2").alias("text"))
    return _rows(chunking.chunks(rows, ["doc_id"], "text", chunking.greedy), "doc_id")


@query()
def sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of about a thousand characters at ends of sentences and paragraphs; a fold over each text, beyond SQL."""
    rows = read(spark, sf_dir, "documents").select("doc_id", P.chunk_clean(F.col("text"), 3).alias("text"))
    return _rows(chunking.chunks(rows, ["doc_id"], "text", chunking.by_sentences), "doc_id")


@query()
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each section of a book that keep formulas, definitions and examples whole; a fold over each section, beyond SQL."""
    return _rows(chunking.chunks_of_sections(books(spark, sf_dir), chunking.by_structure), "book_id", "section")


@query()
def region_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each section's chunks by the first formula, definition or example that reaches into them; a fold over each section, beyond SQL."""
    found = chunking.chunks_of_sections(books(spark, sf_dir), chunking.by_structure_with_kinds, chunking.KIND_COLUMNS)
    return found.select("book_id", "section", "chunk_no", "begin", "finish", "kind", "kind_from_start", "regions")


@query()
def book_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books in chunks, by structure or by sentences, as each one's assessment says."""
    found = chunking.chunked(books(spark, sf_dir))
    return found.select("book_id", "way", "chunk_no", "kind", F.round("sure", 4).alias("sure"), F.length("chunk").cast("long").alias("characters"), F.md5("chunk").alias("digest"))


_CONCEPT = r"(?i)(?:definition|theorem|example|exercise|introduction to)\s+([A-Za-z]+)"


@query(f"""WITH {BOOKS_SQL}, l AS (SELECT book_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM books), c AS (SELECT book_id, line_no, lower(regexp_extract(line, '{_CONCEPT}', 1)) AS concept FROM l WHERE regexp_matches(line, '{_CONCEPT}')),
f AS (SELECT book_id, concept, min(line_no) AS first_line FROM c GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY first_line, concept) AS place, lead(first_line) OVER (PARTITION BY book_id ORDER BY first_line, concept) AS next_line FROM f)
SELECT book_id, concept, place, first_line, CAST(coalesce(next_line, (SELECT max(line_no) + 1 FROM l WHERE l.book_id = n.book_id)) - first_line AS BIGINT) AS lines FROM n WHERE place <= 10""")
def book_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts that lines introduce, each once at its first line, ten for each book, with the lines up to the next one: a chunk for each concept."""
    lines = books(spark, sf_dir).select("book_id", F.size(F.split("text", "\n")).alias("total"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = lines.where(F.col("line").rlike(_CONCEPT)).select("book_id", "total", "line_no", F.lower(F.regexp_extract("line", _CONCEPT, 1)).alias("concept"))
    first = found.groupBy("book_id", "concept").agg(F.min("line_no").alias("first_line"), F.max("total").alias("total"))
    w = Window.partitionBy("book_id").orderBy("first_line", "concept")
    rows = first.select("book_id", "concept", F.row_number().over(w).cast("long").alias("place"), F.col("first_line").cast("long").alias("first_line"), (F.coalesce(F.lead("first_line").over(w), F.col("total")) - F.col("first_line")).cast("long").alias("lines"))
    return rows.where("place <= 10")


def _form_sql(form: int) -> str:
    p = concepts.FORMS[form].replace("'", "''")
    return f"""SELECT book_id, section, length(text) AS size, {form} AS form, regexp_extract_all(text, '{p}', 0) AS ms, regexp_extract_all(text, '{p}', 1) AS ns, string_split_regex(text, '{p}') AS ps FROM sec"""


@query(typed(f"""WITH {ELEMENTS_SQL}, sp AS (SELECT a.book_id, a.start, coalesce((SELECT min(b.start) FROM e b WHERE b.book_id = a.book_id AND b.line_no > a.line_no AND b.level <= a.level), (SELECT max(finish) FROM e b WHERE b.book_id = a.book_id)) AS until FROM e a),
sec AS (SELECT book_id, coalesce(start, 0) AS section, CASE WHEN start IS NULL THEN text ELSE substr(text, start + 1, until - start) END AS text FROM books LEFT JOIN sp USING (book_id)),
f AS ({" UNION ALL ".join(_form_sql(k) for k in range(len(concepts.FORMS)))}), i AS (SELECT *, unnest(range(len(ms))) AS i FROM f),
x AS (SELECT book_id, section, size, form, list_sum(list_transform(ps[1:i + 1], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i], lambda m: length(m))), 0) AS pos, substr(regexp_replace(regexp_replace(ns[i + 1], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), 1, 100) AS concept FROM i),
n AS (SELECT book_id, section, concept, max(size) AS size, arg_min(pos, form * 1000000000000 + pos) AS pos FROM x WHERE concept <> '' GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER w AS place, coalesce(lead(pos) OVER w, size) AS finish FROM n WINDOW w AS (PARTITION BY book_id, section ORDER BY pos))
SELECT book_id, section, place, concept, pos AS "begin", finish FROM o WHERE place <= 10""", section="BIGINT", finish="BIGINT", **{'"begin"': "BIGINT"}))
def section_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten concepts of each section, by the words, the marks and the numbered headings that introduce them, each with the text up to the next one."""
    found = concepts.introduced(chunking.sections(books(spark, sf_dir)), ["book_id", "section"])
    return found.withColumn("section", F.col("section").cast("long"))
