"""Queries of prose: cleaning in full, measures of chunks, parsing of generated texts, keys and strings of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import prose as P
from .projection import read
from .registry import query, typed

_W = r"[^\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
_COUNT = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"


def _sub(text: str, pattern: str, by: str, options: str = "g") -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', '{options}')"


def _artifacts(text: str) -> tuple[str, str]:
    """The text without header and footer lines, and how many there were."""
    counts = []
    for k, pattern in enumerate(P.ARTIFACTS):
        flagged = ("(?mi)" if k in P.IGNORE_CASE else "(?m)") + pattern
        counts.append(_COUNT(text, flagged))
        text = _sub(text, flagged, "")
    return text, " + ".join(counts)


def _repairs(part: str) -> str:
    for pattern, by in P.MISSING_BLANKS:
        part = _sub(part, pattern, by.replace("$", "\\"))
    return part


_MAPPED = f"replace(translate(text, '{P.REPLACED[0]}', '{P.REPLACED[1].replace(chr(39), chr(39) * 2)}'), '…', '...')"
_STEPS = f"""s1 AS (SELECT doc_id, text, {_artifacts('m')[0]} AS t, {_artifacts('m')[1]} AS artifacts FROM (SELECT doc_id, text, {_MAPPED} AS m FROM documents)),
s2 AS (SELECT doc_id, text, artifacts, len(regexp_extract_all(t, '{P.MATH}')) AS maths, array_to_string(list_transform(list_zip(list_transform(regexp_split_to_array(t, '{P.MATH}'), lambda p: {_repairs('p')}), list_append(regexp_extract_all(t, '{P.MATH}'), '')), lambda z: z[1] || coalesce(z[2], '')), '') AS t FROM s1),
s3 AS (SELECT doc_id, text, artifacts, maths, {_sub(_sub(_sub(_sub('t', '[ \t]+', ' '), ' ?\n ?', chr(10)), '\n{3,}', chr(10) * 2), '^[ \n]+|[ \n]+$', '')} AS t FROM s2),
s4 AS (SELECT doc_id, text, artifacts, maths, {_sub(_sub('t', '([^.!?\n])\n([a-z])', '\\1 \\2'), '([^.!?\n])\n([a-z])', '\\1 \\2')} AS t FROM s3),
c AS (SELECT doc_id, text, artifacts, maths, array_to_string(list_transform(string_split(t, chr(10) || chr(10)), lambda p: replace(p, chr(10), ' ')), chr(10) || chr(10)) AS clean FROM s4)"""


@query(typed(f"""WITH {_STEPS} SELECT doc_id, length(clean) AS characters, md5(clean) AS digest, artifacts, maths, round(CASE WHEN clean = '' THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - CASE WHEN length(clean) / length(text) < 0.5 THEN 0.3 WHEN length(clean) / length(text) < 0.8 THEN 0.1 ELSE 0 END
  + least(0.2, (artifacts + maths) * 0.01) + CASE WHEN {_COUNT('clean', '[.!?]+')} * 100 / {_COUNT('clean', _W)} BETWEEN 5 AND 20 THEN 0.1 ELSE 0 END + CASE WHEN contains(clean, chr(10) || chr(10)) THEN 0.05 ELSE 0 END)) END, 6) AS quality FROM c""", quality="DOUBLE"))
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight steps of cleaning and the quality of the outcome."""
    t = F.regexp_replace(F.translate("text", *P.REPLACED), "…", "...")
    # A file with one row group is one task, whatever its size; the steps are many passes over each text.
    docs = read(spark, sf_dir, "documents").select("doc_id", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    rows = docs.select("doc_id", "text", P.artifact_count(t).cast("long").alias("artifacts"), P.without_artifacts(t).alias("t"))
    rows = rows.withColumn("maths", F.regexp_count("t", F.lit(P.MATH)).cast("long")).withColumn("clean", P.paragraphs(P.rejoined(P.normal_blanks(P.with_blanks(F.col("t"))))))
    quality = F.round(P.cleaning_quality(F.col("text"), F.col("clean"), F.col("artifacts") + F.col("maths")), 6)
    return rows.select("doc_id", F.length("clean").cast("long").alias("characters"), F.md5("clean").alias("digest"), "artifacts", "maths", quality.alias("quality"))


def _chunk_clean_sql(least: int) -> str:
    t = _sub(_sub("text", "\n[ \t\n]*\n[ \t]*\n+", chr(10) * 2), " +", " ")
    t = _sub(_sub(t, "(?m)^Page \\d+[^\n]*\n", ""), "(?m)\n[^\n]*Page \\d+[^\n]*$", "")
    return _sub(_sub(t, f"(?m)^[-_]{{{least},}}[^\n]*$", ""), "^[ \n\t]+|[ \n\t]+$", "")


@query(f"SELECT doc_id, md5({_chunk_clean_sql(5)}) AS structured, md5({_chunk_clean_sql(3)}) AS fallback FROM documents")
def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(P.chunk_clean(F.col("text"), 5)).alias("structured"), F.md5(P.chunk_clean(F.col("text"), 3)).alias("fallback"))


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{_W}') AS w FROM documents)
SELECT doc_id, md5('Represent:' || chr(10) || chr(10) || CASE WHEN len(w) > 96 THEN array_to_string(w[1:96], ' ') || '...' ELSE array_to_string(w, ' ') END) AS digest FROM w""")
def embedding_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(P.embedding_input(F.col("text"), 128, "Represent:")).alias("digest"))


def _keywords_sql(stops: list[str]) -> str:
    return f"""WITH k AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$')) AS w FROM documents)),
c AS (SELECT doc_id, word, count(*) AS n, min(place) AS first FROM k WHERE word NOT IN ({", ".join(f"'{s}'" for s in stops)}) GROUP BY 1, 2)
SELECT doc_id, word, n, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS place FROM c) WHERE place <= 5"""


def _keywords(spark: SparkSession, sf_dir: str, stops: list[str]) -> DataFrame:
    """Five words of each chunk, the first of equally frequent ones.  A chunk's words are counted in the task that reads it, before counts are shuffled."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[a-z]{3,}$") & ~w.isin(stops))
    counts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("at", "word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return counts.withColumn("place", place.cast("long")).where("place <= 5").select("doc_id", "word", "n", "place")


@query(_keywords_sql(P.STOP_WORDS))
def chunk_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keywords(spark, sf_dir, P.STOP_WORDS)


@query(_keywords_sql(P.STOP_WORDS + P.PRONOUNS))
def chunk_keywords_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keywords(spark, sf_dir, P.STOP_WORDS + P.PRONOUNS)


_ANY = lambda t, marks: "(" + " OR ".join(f"contains({t}, '{m}')" for m in marks) + ")"
_KIND = f"CASE WHEN {_ANY('text', P.MATH_MARKS)} THEN 'math' WHEN {_ANY('lower(text)', P.DEFINITION_MARKS)} THEN 'definition' WHEN {_ANY('lower(text)', P.EXAMPLE_MARKS)} THEN 'example' ELSE 'text' END"
_MEASURES = f"""d AS (SELECT doc_id, text, length(text) AS n, {_KIND} AS kind, {_COUNT('text', _W)} AS words, {_COUNT('text', '[.!?]+')} AS ends, regexp_matches({_sub('text', _GAP + '$', '')}, '[.!?]$') AS whole,
  coalesce(length({_sub('text', _GAP, '')}) / nullif({_COUNT('text', _W)}, 0), 0) AS word_length, list_sum(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: {_COUNT('s', _W)})) / len(regexp_split_to_array(text, '[.!?]+')) AS sentence,
  len(list_distinct(regexp_extract_all(text, '[{P.SYMBOLS}]'))) AS symbols, regexp_extract_all(lower(text), '{_W}') AS w FROM documents),
m AS (SELECT *, CASE WHEN word_length > 6 THEN 0.1 ELSE 0 END + CASE WHEN sentence > 20 THEN 0.1 ELSE 0 END AS more, CASE WHEN n BETWEEN 300 AND 1500 THEN 0.1 WHEN n < 300 THEN -0.2 ELSE 0 END AS size, CASE WHEN words = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END AS uniq FROM d),
q AS (SELECT *, greatest(0.0, least(1.0, 0.8 + size + CASE WHEN kind <> 'text' THEN 0.1 ELSE 0 END - CASE WHEN ends > 0 AND NOT whole THEN 0.1 ELSE 0 END)) AS sure,
  greatest(0.0, least(1.0, 0.6 + size + CASE WHEN ends = 0 THEN 0 WHEN whole THEN 0.1 ELSE -0.1 END + CASE WHEN ends > 0 AND words / ends BETWEEN 5 AND 25 THEN 0.05 ELSE 0 END)) AS sure_fallback FROM m)"""


@query(typed(f"""WITH {_MEASURES} SELECT doc_id, kind, round(greatest(0.0, least(1.0, 0.5 + CASE kind WHEN 'math' THEN 0.2 WHEN 'definition' THEN 0.15 WHEN 'example' THEN -0.1 ELSE 0 END + more + symbols * 0.02)), 6) AS difficulty,
  round(greatest(0.0, least(1.0, 0.4 + CASE kind WHEN 'math' THEN 0.3 WHEN 'definition' THEN 0.2 WHEN 'example' THEN -0.1 ELSE 0 END + more)), 6) AS difficulty_fallback, round(sure, 6) AS sure, round(sure_fallback, 6) AS sure_fallback,
  round(uniq, 6) AS unique_share, length({_sub('text', f'^{_GAP}|{_GAP}$', '')}) >= 50 AND words >= 5 AND sure >= 0.2 AND (words <= 10 OR uniq >= 0.3) AS is_valid FROM q""", difficulty="DOUBLE", difficulty_fallback="DOUBLE", sure="DOUBLE", sure_fallback="DOUBLE"))
def chunk_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, kind = F.col("text"), F.col("kind")
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", P.kind_of_chunk(F.col("text")).alias("kind"))
    six = lambda c, name: F.round(c, 6).alias(name)
    rows = rows.withColumn("s", P.confidence(t, kind))
    return rows.select("doc_id", "kind", six(P.difficulty(t, kind), "difficulty"), six(P.difficulty(t, kind, False), "difficulty_fallback"), six(F.col("s"), "sure"), six(P.confidence(t, kind, False), "sure_fallback"), six(P.unique_share(t), "unique_share"), P.is_valid_chunk(t, F.col("s")).alias("is_valid"))


_TURNS = "t AS (SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    asked, said = (rows.where(F.col("role") == r) for r in ("user", "assistant"))
    said = said.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.select("conv_id", "turn", F.col("text").alias("question")).join(said, ["conv_id", "turn"])


@query(f"""WITH {_TURNS}, s AS (SELECT *, list_distinct(regexp_extract_all(lower(question), '{_W}')) AS a, list_distinct(regexp_extract_all(lower(answer), '{_W}')) AS b FROM t)
SELECT conv_id, turn, round(CASE WHEN len(b) = 0 THEN 0.5 ELSE least(0.9, len(list_intersect(a, b)) / len(b)) END * CASE WHEN length(question) < 50 THEN 0.8 ELSE 1 END, 2) AS score FROM s""")
def answer_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of an expected answer's words is in the given one."""
    return _turns(spark, sf_dir).select("conv_id", "turn", P.overlap_score(F.col("question"), F.col("answer")).alias("score"))


_REPLY = f"r AS (SELECT conv_id, turn, 'SCORE: ' || (turn % 15) / 10 || chr(10) || 'FEEDBACK: ' || question || chr(10) || 'SUGGESTIONS: ' || CASE WHEN turn % 4 = 0 THEN 'none' ELSE '1. ' || left(answer, 60) || '; ' || right(answer, 40) || ', short' END AS reply FROM t)"


@query(f"""WITH {_TURNS}, {_REPLY}, p AS (SELECT conv_id, turn, greatest(0.0, least(1.0, coalesce(try_cast(nullif(regexp_extract(reply, '(?i)SCORE:\\s*([\\d.]+)', 1), '') AS DOUBLE), 0.5))) AS score, trim(regexp_extract(reply, '(?is)FEEDBACK:\\s*(.+?)\\s*(?:SUGGESTIONS:|$)', 1), ' ') AS feedback,
  list_filter(list_transform(regexp_split_to_array(regexp_extract(reply, '(?is)SUGGESTIONS:\\s*(.+)$', 1), '[,;]|\\d+\\.|\n-'), lambda x: {_sub('x', f'^{_GAP}|{_GAP}$', '')}), lambda x: length(x) > 10) AS found FROM r)
SELECT conv_id, turn, score, length(feedback) AS feedback_length, len(found[1:3]) AS suggestions, md5(array_to_string(found[1:3], '|')) AS digest, length(feedback) >= 20 AND (score >= 0.8 OR len(found) > 0) AS is_valid FROM p""")
def parsed_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, feedback and suggestions from a generated evaluation, and whether it is usable."""
    answer = F.col("answer")
    more = F.concat(F.lit("1. "), F.left(answer, F.lit(60)), F.lit("; "), F.right(answer, F.lit(40)), F.lit(", short"))
    reply = F.concat(F.lit("SCORE: "), (F.col("turn") % 15 / 10).cast("string"), F.lit("\nFEEDBACK: "), "question", F.lit("\nSUGGESTIONS: "), F.when(F.col("turn") % 4 == 0, "none").otherwise(more))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", reply.alias("reply"))
    score = F.coalesce(F.regexp_extract("reply", r"(?i)SCORE:\s*([\d.]+)", 1).try_cast("double"), F.lit(0.5))
    rows = rows.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).withColumn("feedback", F.trim(F.regexp_extract("reply", r"(?is)FEEDBACK:\s*(.+?)\s*(?:SUGGESTIONS:|$)", 1)))
    parts = F.transform(F.split(F.regexp_extract("reply", r"(?is)SUGGESTIONS:\s*(.+)$", 1), r"[,;]|\d+\.|\n-"), lambda x: F.regexp_replace(x, f"^{_GAP}|{_GAP}$", ""))
    rows = rows.withColumn("found", F.slice(F.filter(parts, lambda x: F.length(x) > 10), 1, 3))
    n = F.size("found").cast("long")
    return rows.select("conv_id", "turn", "score", F.length("feedback").cast("long").alias("feedback_length"), n.alias("suggestions"), F.md5(F.array_join("found", "|")).alias("digest"), ((F.length("feedback") >= 20) & ((F.col("score") >= 0.8) | (n > 0))).alias("is_valid"))


def _generated_sql(t: str) -> str:
    t = _sub(_sub(_sub(t, "(?i)^(question|expected_answer):\\s*", "", "c"), "^\\d+\\.\\s*", "", "c"), "^[-*]\\s*", "", "c")
    return f"trim({_sub(t, _GAP, ' ')}, ' ')"


@query(f"""WITH {_TURNS}, r AS (SELECT conv_id, turn, 'QUESTION: 1. ' || question || '?' || chr(10) || 'EXPECTED_ANSWER: - ' || answer || ' and so' AS reply FROM t),
x AS (SELECT conv_id, turn, {_generated_sql("regexp_extract(reply, '(?is)QUESTION:\\s*(.+?)\\s*(?:EXPECTED_ANSWER:|$)', 1)")} AS q, {_generated_sql("regexp_extract(reply, '(?is)EXPECTED_ANSWER:\\s*(.+?)\\s*$', 1)")} AS a FROM r),
y AS (SELECT *, regexp_split_to_array(q, '[.!?]+') AS qs, regexp_split_to_array(a, '[.!?]+') AS ps FROM x),
z AS (SELECT conv_id, turn, CASE WHEN q = '' OR regexp_matches(q, '[.!?;:]$') OR len(qs) < 2 THEN q ELSE array_to_string(qs[1:-2], '.') || '.' END AS q, CASE WHEN a = '' OR regexp_matches(a, '[.!?;:]$') OR len(ps) < 2 THEN a ELSE array_to_string(ps[1:-2], '.') || '.' END AS a FROM y)
SELECT conv_id, turn, md5(q) AS question, md5(a) AS answer, length(q) BETWEEN 100 AND 500 AND length(a) BETWEEN 200 AND 1000 AND regexp_matches(q, '\\?$') AND NOT regexp_matches(lower(q || a), '\\.\\.\\.|etc\\.|\\[') AND len(list_filter(['et', 'de'], lambda w: contains(lower(q || ' ' || a), w))) / 2 >= 0.3 AS is_valid FROM z""")
def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and expected answer from generated text, without labels and fragments, and whether they are usable."""
    reply = F.concat(F.lit("QUESTION: 1. "), "question", F.lit("?\nEXPECTED_ANSWER: - "), "answer", F.lit(" and so"))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", reply.alias("reply"))
    rows = rows.select("conv_id", "turn", P.generated(P.labelled(F.col("reply"), "QUESTION", "EXPECTED_ANSWER:")).alias("q"), P.generated(P.labelled(F.col("reply"), "EXPECTED_ANSWER")).alias("a"))
    q, a = F.col("q"), F.col("a")
    words = F.filter(F.array(F.lit("et"), F.lit("de")), lambda w: F.lower(F.concat(q, F.lit(" "), a)).contains(w))
    ok = F.length(q).between(100, 500) & F.length(a).between(200, 1000) & q.rlike(r"\?$") & ~F.lower(F.concat(q, a)).rlike(r"\.\.\.|etc\.|\[") & (F.size(words) / 2 >= 0.3)
    return rows.select("conv_id", "turn", F.md5(q).alias("question"), F.md5(a).alias("answer"), ok.alias("is_valid"))


@query(typed(f"""WITH {_TURNS}, r AS (SELECT conv_id, turn, 'SENTENCE_1: ' || left(question, 80) || chr(10) || 'SENTENCE_2: ' || left(answer, 90) || chr(10) || 'SENTENCE_3: no' AS reply FROM t),
s AS (SELECT conv_id, turn, unnest(regexp_split_to_array(reply, '(?i)SENTENCE_\\d+:')) AS s, unnest(range(len(regexp_split_to_array(reply, '(?i)SENTENCE_\\d+:')))) AS place FROM r),
k AS (SELECT conv_id, turn, place, trim({_sub('s', _GAP, ' ')}, ' ') AS s FROM s WHERE place > 0) SELECT conv_id, turn, count(*) AS sentences, md5(string_agg(s, ' ' ORDER BY place)) AS digest, sum(length(s)) + count(*) - 1 AS total_length FROM k WHERE length(s) > 20 GROUP BY 1, 2""", total_length="BIGINT"))
def parsed_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered sentences of generated text, those of more than 20 characters, joined in order."""
    reply = F.concat(F.lit("SENTENCE_1: "), F.left("question", F.lit(80)), F.lit("\nSENTENCE_2: "), F.left("answer", F.lit(90)), F.lit("\nSENTENCE_3: no"))
    parts = F.transform(F.slice(F.split(reply, r"(?i)SENTENCE_\d+:"), 2, 1000), lambda s: F.trim(F.regexp_replace(s, _GAP, " ")))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.filter(parts, lambda s: F.length(s) > 20).alias("s")).where(F.size("s") > 0)
    joined = F.array_join("s", " ")
    return rows.select("conv_id", "turn", F.size("s").cast("long").alias("sentences"), F.md5(joined).alias("digest"), F.length(joined).cast("long").alias("total_length"))


@query("""SELECT p_partkey AS concept, 'Title: ' || p_name || ' Description: ' || p_type || ' Learning objectives: ' || p_brand || ' ' || p_size || CASE WHEN p_size > 25 THEN ' Tags: large' ELSE '' END AS text, 'Query: ' || p_name || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'Context: ' || p_type ELSE '' END AS search,
  md5(p_name || p_type || '||model-1') AS content_key, sha256(trim(regexp_replace(regexp_replace(regexp_replace('match $id where x = ''' || p_brand || ''' limit ' || p_size, '\\$\\w+', '$param', 'g'), '''[^'']*''', '''literal''', 'g'), '\\d+', 'N', 'g')) || '{"size":' || p_size || '}') AS cache_key FROM part""")
def concept_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that concepts and searches are embedded by, and keys of contents and of queries without their literals."""
    rows = read(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    text = F.concat_ws(" ", F.concat(F.lit("Title: "), "p_name"), F.concat(F.lit("Description: "), "p_type"), F.concat(F.lit("Learning objectives: "), "p_brand", F.lit(" "), size), F.when(F.col("p_size") > 25, "Tags: large"))
    search = F.concat_ws("\n", F.concat(F.lit("Query: "), "p_name"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Context: "), "p_type")))
    command = F.concat(F.lit("match $id where x = '"), "p_brand", F.lit("' limit "), size)
    pattern = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(command, r"\$\w+", r"\$param"), "'[^']*'", "'literal'"), r"\d+", "N"))
    return rows.select(F.col("p_partkey").alias("concept"), text.alias("text"), search.alias("search"), F.md5(F.concat("p_name", "p_type", F.lit("||model-1"))).alias("content_key"), F.sha2(F.concat(pattern, F.to_json(F.struct(F.col("p_size").alias("size")))), 256).alias("cache_key"))


@query(f"SELECT doc_id, array_to_string(list_filter({P.TEACHING}, lambda t: contains(lower(text), t)), ',') AS terms, round(CASE WHEN regexp_matches(text, '^\\s*$') THEN 0.0 ELSE greatest(0.0, least(1.0, 0.8 - CASE WHEN length(text) < 50 THEN 0.2 ELSE 0 END - {_COUNT('text', '[\\x00-\\x08\\x0b-\\x1f\\x7f]')} / length(text) * 0.3 + CASE WHEN contains(text, '. ') AND {_COUNT('text', '\\.')} > 1 THEN 0.1 ELSE 0 END)) END, 6) AS page_confidence FROM documents")
def teaching_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of teaching that a text holds, and how well it reads as a page's text."""
    t = F.col("text")
    terms = F.filter(F.array(*(F.lit(x) for x in P.TEACHING)), lambda x: F.lower(t).contains(x))
    odd = F.regexp_count(t, F.lit(r"[\x00-\x08\x0b-\x1f\x7f]")) / F.length(t)
    sure = F.when(t.rlike(r"^\s*$"), 0.0).otherwise(P.clamped(0.8 - F.when(F.length(t) < 50, 0.2).otherwise(0.0) - odd * 0.3 + F.when(t.contains(". ") & (F.regexp_count(t, F.lit(r"\.")) > 1), 0.1).otherwise(0.0)))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(terms, ",").alias("terms"), F.round(sure, 6).alias("page_confidence"))


@query("""WITH p AS (SELECT l_orderkey AS chunk, list_sort(list(DISTINCT l_partkey % 50 + 1)) AS pages, min(l_suppkey) AS chapter, max(l_linenumber) AS section, sum(l_quantity) AS minutes FROM lineitem GROUP BY 1)
SELECT chunk, CASE WHEN len(pages) = 1 THEN CAST(pages[1] AS VARCHAR) ELSE pages[1] || '-' || pages[-1] END AS page_range, CASE WHEN chapter % 5 = 0 AND section % 2 = 0 THEN 'Root' ELSE concat_ws(' > ', CASE WHEN chapter % 5 <> 0 THEN 'Ch.' || chapter END, CASE WHEN section % 2 <> 0 THEN 'Sec.' || section END) END AS path,
  CASE WHEN minutes < 60 THEN CAST(floor(minutes) AS INT) || 'm' WHEN minutes < 1440 THEN CAST(floor(minutes / 60) AS INT) || 'h ' || CAST(floor(minutes % 60) AS INT) || 'm' ELSE CAST(floor(minutes / 1440) AS INT) || 'd ' || CAST(floor(minutes / 60) AS INT) % 24 || 'h' END AS duration FROM p""")
def chunk_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges, hierarchical paths and durations in words."""
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("chunk")).agg(F.min(F.col("l_partkey") % 50 + 1).alias("first"), F.max(F.col("l_partkey") % 50 + 1).alias("last"), F.min("l_suppkey").alias("chapter"), F.max("l_linenumber").alias("section"), F.sum("l_quantity").alias("minutes"))
    whole = F.floor("minutes").cast("int")
    hours = F.floor(F.col("minutes") / 60).cast("int")
    pages = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    path = F.concat_ws(" > ", F.when(F.col("chapter") % 5 != 0, F.concat(F.lit("Ch."), F.col("chapter").cast("string"))), F.when(F.col("section") % 2 != 0, F.concat(F.lit("Sec."), F.col("section").cast("string"))))
    text = F.when(F.col("minutes") < 60, F.format_string("%dm", whole)).when(F.col("minutes") < 1440, F.format_string("%dh %dm", hours, whole % 60)).otherwise(F.format_string("%dd %dh", F.floor(hours / 24).cast("int"), hours % 24))
    return rows.select("chunk", pages.alias("page_range"), F.when(path == "", "Root").otherwise(path).alias("path"), text.alias("duration"))


_META = f"""x AS (SELECT doc_id, source, {_KIND} AS kind, (doc_id % 11) / 10 AS difficulty, (doc_id % 7) / 6 AS sure, (doc_id % 3) / 2 AS quality, doc_id % 13 AS keywords, {_COUNT('text', _W)} AS words, {_COUNT('text', '[.!?]+')} AS sentences, length(text) AS chars, doc_id * 10 AS begin, doc_id * 10 + n_chars AS finish FROM documents)"""


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = F.col("text"), F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "doc_id", "source", P.kind_of_chunk(t).alias("kind"), (k % 11 / 10).alias("difficulty"), (k % 7 / 6).alias("sure"), (k % 3 / 2).alias("quality"), (k % 13).alias("keywords"),
        F.regexp_count(t, F.lit(P.WORD)).alias("words"), F.regexp_count(t, F.lit("[.!?]+")).alias("sentences"), F.length(t).alias("chars"), (k * 10).alias("begin"), (k * 10 + F.col("n_chars")).alias("finish"))


@query(typed(f"""WITH {_META} SELECT doc_id, CASE WHEN difficulty < 0.25 THEN 'beginner' WHEN difficulty < 0.5 THEN 'intermediate' WHEN difficulty < 0.75 THEN 'advanced' ELSE 'expert' END AS level, CASE WHEN difficulty < 0.25 THEN 0.125 WHEN difficulty < 0.5 THEN 0.375 WHEN difficulty < 0.75 THEN 0.625 ELSE 0.875 END AS level_score,
  round(0.4 * difficulty + 0.3 * (1 - sure) + 0.15 * quality + 0.1 * least(1.0, keywords / 10) + 0.05 * least(1.0, sentences / 20), 6) AS complexity,
  concat_ws(',', CASE WHEN chars > 0 AND abs(finish - begin - chars) > chars * 0.1 THEN 'position' END, CASE WHEN words > 0 AND sentences > 0 AND (words / sentences < 3 OR words / sentences > 50) THEN 'sentences' END, CASE WHEN kind = 'definition' AND difficulty < 0.3 THEN 'definition' END) AS issues,
  difficulty BETWEEN 0 AND 1 AND sure BETWEEN 0 AND 1 AND quality BETWEEN 0 AND 1 AND begin >= 0 AND finish >= begin AND chars >= 0 AND words >= 0 AND sentences >= 0 AS in_range, '{{"kind":"' || kind || '","words":' || words || '}}' AS json FROM x""", level_score="DOUBLE"))
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, complexity, consistency and ranges of chunks' metadata, and the metadata as JSON."""
    d, s, q = F.col("difficulty"), F.col("sure"), F.col("quality")
    banded = lambda *v: F.when(d < 0.25, v[0]).when(d < 0.5, v[1]).when(d < 0.75, v[2]).otherwise(v[3])
    per_sentence = F.try_divide("words", "sentences")
    issues = F.concat_ws(",", F.when((F.col("chars") > 0) & (F.abs(F.col("finish") - F.col("begin") - F.col("chars")) > F.col("chars") * 0.1), "position"), F.when((F.col("words") > 0) & ((per_sentence < 3) | (per_sentence > 50)), "sentences"), F.when((F.col("kind") == "definition") & (d < 0.3), "definition"))
    in_range = d.between(0, 1) & s.between(0, 1) & q.between(0, 1) & (F.col("begin") >= 0) & (F.col("finish") >= F.col("begin")) & (F.least("chars", "words", "sentences") >= 0)
    complexity = 0.4 * d + 0.3 * (1 - s) + 0.15 * q + 0.1 * F.least(F.lit(1.0), F.col("keywords") / 10) + 0.05 * F.least(F.lit(1.0), F.col("sentences") / 20)
    return _meta(spark, sf_dir).select("doc_id", banded("beginner", "intermediate", "advanced", "expert").alias("level"), banded(0.125, 0.375, 0.625, 0.875).alias("level_score"), F.round(complexity, 6).alias("complexity"), issues.alias("issues"), in_range.alias("in_range"), F.to_json(F.struct("kind", "words")).alias("json"))


_PRIORITY = "CASE kind WHEN 'math' THEN 5 WHEN 'definition' THEN 3 WHEN 'example' THEN 3 ELSE 1 END"


@query(typed(f"""WITH {_META} SELECT source, max(difficulty) AS difficulty, round(min(sure), 6) AS sure, min(begin) AS begin, max(finish) AS finish, sum(words) AS words, sum(chars) AS chars, round(avg(quality), 6) AS quality, arg_min(kind, [-({_PRIORITY}), doc_id]) AS kind, count(DISTINCT keywords) AS keywords FROM x WHERE source IS NOT NULL GROUP BY 1""", words="BIGINT", chars="BIGINT"))
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata of a book's chunks in one: most difficult, least sure, widest, and the kind that goes before others."""
    k = F.col("kind")
    order = F.struct(F.when(k == "math", -5).when(k.isin("definition", "example"), -3).otherwise(-1), "doc_id")
    return _meta(spark, sf_dir).where("source IS NOT NULL").groupBy("source").agg(
        F.max("difficulty").alias("difficulty"), F.round(F.min("sure"), 6).alias("sure"), F.min("begin").alias("begin"), F.max("finish").alias("finish"), F.sum("words").alias("words"), F.sum("chars").alias("chars"),
        F.round(F.avg("quality"), 6).alias("quality"), F.min_by("kind", order).alias("kind"), F.count_distinct("keywords").alias("keywords"))


_TERM = "regexp_replace(w, '(ing|ed|es|s)$', '')"


@query(f"""WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z]+'), lambda w: {_TERM}) AS terms FROM documents),
s AS (SELECT doc_id, len(terms) AS n, len(list_filter(terms, lambda t: t = 'nicht')) AS a, len(list_filter(terms, lambda t: t = 'die')) AS b FROM d)
SELECT doc_id, round((a + b) / (1 + ln(n)), 6) AS rank FROM s WHERE a > 0 AND b > 0 ORDER BY rank DESC, doc_id LIMIT 20""")
def fulltext_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold every term of "The nichts die", stop words left out and endings cut, ranked by uses against the logarithm of the length.

    A scan and a top-k; words are not exploded.
    """
    from ..operators.fulltext import ranked

    return ranked(read(spark, sf_dir, "documents"), "doc_id", "text", "The nichts die", 20)
