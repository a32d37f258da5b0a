"""Queries of chunks' texts and of web pages, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .projection import read
from .registry import query

_WORD = r"[^\x20\x09-\x0D]+"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_KEYWORDS_SQL = f"k AS (SELECT doc_id, lang, word FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS word FROM documents) WHERE word NOT IN ({_STOP}))"


@query(f"""SELECT doc_id, length(text) AS characters, len(regexp_extract_all(text, '{_WORD}')) AS words, len(regexp_extract_all(text, '[.!?]+')) AS sentences,
  CAST(greatest(1, floor(len(regexp_extract_all(text, '{_WORD}')) * 1.3)) AS BIGINT) AS tokens FROM documents""")
def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("characters"), T.word_count(t).cast("long").alias("words"), T.sentence_count(t).cast("long").alias("sentences"), T.token_estimate(t).cast("long").alias("tokens"))


@query(f"WITH {_KEYWORDS_SQL}, c AS (SELECT lang, word, count(*) AS uses, count(DISTINCT doc_id) AS chunks FROM k GROUP BY 1, 2) SELECT lang, word, uses, chunks FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY uses DESC, word) AS place FROM c) WHERE place <= 20")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's words are sorted, so that the first of equal ones can be marked: uses and chunks are then counted in one shuffle of words."""
    found = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))
    sorted_words = read(spark, sf_dir, "documents").select("lang", F.sort_array(found).alias("ws"))
    marked = F.transform("ws", lambda w, i: F.struct(w.alias("word"), ((i == 0) | (F.get("ws", i - 1) != w)).cast("int").alias("first")))
    rows = sorted_words.select("lang", F.explode(marked).alias("m")).where(~F.col("m.word").isin(T.STOP_WORDS))
    counts = rows.groupBy("lang", "m.word").agg(F.count("*").alias("uses"), F.sum("m.first").alias("chunks"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("uses"), "word"))
    return counts.withColumn("place", place).where("place <= 20").select("lang", "word", "uses", "chunks")


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'equation|formula|theorem|[=<>]') THEN 'math' WHEN regexp_matches(lower(text), 'definition|is defined as') THEN 'definition'
  WHEN regexp_matches(lower(text), 'example|for instance') THEN 'example' ELSE 'text' END AS kind, CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS preview FROM documents""")
def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.content_type(F.col("text")).alias("kind"), T.truncated(F.col("text"), 500).alias("preview"))


@query("""SELECT page_id, length(t) AS characters, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM pages)""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "pages").select("page_id", T.strip_tags(F.col("html")).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("characters"), F.md5("t").alias("digest"))


@query()
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned chunks with the share of characters left: the line-wise rules follow Java's line ends, which SQL elsewhere does not."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", T.clean(F.col("text")).alias("clean_text"))
    return rows.select("doc_id", "clean_text", F.round(F.try_divide(F.length("clean_text"), F.length("text")), 4).alias("left_share"))
