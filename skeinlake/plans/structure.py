"""Queries of the structure of books: documents whose lines have been given chapter, section and heading lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import structure as S
from ..operators import structure
from .projection import read
from .registry import query, typed

BOOKS_SQL = """books AS (SELECT doc_id AS book_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l, i: CASE (i - 1) % 7
  WHEN 0 THEN 'Chapter ' || ((i - 1) // 7 + 1) || ': Introduction to ' || coalesce(lang, 'nothing') || chr(10) WHEN 1 THEN 'A. First steps' || chr(10) WHEN 2 THEN CASE (i - 1) // 7 % 4 WHEN 0 THEN 'Key Ideas' WHEN 1 THEN 'References' WHEN 2 THEN 'Glossary' ELSE 'Preface' END || chr(10)
  WHEN 3 THEN '1.' || i || ' Worked example' || chr(10) WHEN 4 THEN 'ii. minor point' || chr(10) WHEN 5 THEN 'EXERCISES' || chr(10) ELSE '' END || l), chr(10)) AS text FROM documents)"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, text: before most lines of a document, a line of one of six forms."""

    def headed(line, i):
        k = F.pmod(i, F.lit(7))
        number = (i + 1).cast("string")
        head = F.when(k == 0, F.concat(F.lit("Chapter "), (F.floor(i / 7) + 1).cast("string"), F.lit(": Introduction to "), F.coalesce("lang", F.lit("nothing")), F.lit("\n")))
        head = head.when(k == 1, "A. First steps\n").when(k == 2, F.concat(F.element_at(F.array(*(F.lit(x) for x in ("Key Ideas", "References", "Glossary", "Preface"))), (F.floor(i / 7) % 4 + 1).cast("int")), F.lit("\n"))).when(k == 3, F.concat(F.lit("1."), number, F.lit(" Worked example\n"))).when(k == 4, "ii. minor point\n").when(k == 5, "EXERCISES\n").otherwise("")
        return F.concat(head, line)

    # A file with one row group is one task, whatever its size.
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text").repartition(4 * spark.sparkContext.defaultParallelism, "doc_id")
    return docs.select(F.col("doc_id").alias("book_id"), F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), headed), "\n").alias("text"))


def _case(branches: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {other} END"


def _hits(patterns, kind: str) -> list[tuple[str, str]]:
    return [(f"regexp_matches(line, '{p}')", f"'{kind}|{name}|{base}'") for name, p, base in patterns]


_GROUP = lambda n: _case([(f"pattern = '{name}'", f"regexp_extract(line, '{p}', {n})") for name, p, _ in S.CHAPTERS + S.SECTIONS], "NULL")
_DIGITS = "regexp_matches(number, '^\\d+$')"
_WORDS = "len(regexp_extract_all(line, '\\S+'))"
_CONFIDENCE = f"""CASE found WHEN 'chapter' THEN base + CASE WHEN {_DIGITS} THEN 0.05 ELSE 0 END - CASE WHEN length(line) < 5 THEN 0.2 WHEN length(line) > 100 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(lower(line), '{S.CHAPTER_WORDS}') THEN 0.05 ELSE 0 END
  WHEN 'section' THEN base + CASE WHEN regexp_matches(number, '^\\d+(\\.\\d+)+$') THEN 0.05 ELSE 0 END - CASE WHEN {_WORDS} < 2 THEN 0.15 ELSE 0 END
  ELSE base + CASE WHEN {_WORDS} BETWEEN 2 AND 10 THEN 0.1 WHEN {_WORDS} > 20 THEN -0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(line), '{S.HEADING_WORDS}') THEN 0.1 ELSE 0 END END"""
ELEMENTS_SQL = f"""{BOOKS_SQL}, lines AS (SELECT book_id, length(text) AS size, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM books),
placed AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line, CAST(coalesce(sum(length(raw) + 1) OVER (PARTITION BY book_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM lines),
told AS (SELECT *, {_case([("length(line) < 2", "NULL")] + _hits(S.CHAPTERS, "chapter") + _hits(S.SECTIONS, "section") + [("length(line) NOT BETWEEN 3 AND 200", "NULL")] + _hits(S.HEADINGS, "heading"), "NULL")} AS tag FROM placed),
parts AS (SELECT book_id, line_no, start, size, line, split_part(tag, '|', 1) AS found, split_part(tag, '|', 2) AS pattern, CAST(split_part(tag, '|', 3) AS DOUBLE) AS base FROM told WHERE tag IS NOT NULL),
numbers AS (SELECT *, {_GROUP(1)} AS number, {_GROUP(2)} AS second FROM parts),
rated AS (SELECT *, round(greatest(0.0, least(1.0, CAST({_CONFIDENCE} AS DOUBLE))), 4) AS confidence, CASE WHEN found = 'chapter' THEN 0 WHEN pattern = 'subsection' THEN 2 ELSE 1 END AS level FROM numbers),
e AS (SELECT book_id, line_no, start, coalesce(lead(start) OVER (PARTITION BY book_id ORDER BY line_no), size) AS finish, CASE WHEN found = 'section' AND level = 2 THEN 'subsection' ELSE found END AS kind, pattern, number,
  CASE WHEN found = 'heading' OR second = '' THEN line ELSE regexp_replace(second, '^\\s+|\\s+$', '', 'g') END AS title, level, confidence,
  CASE WHEN coalesce(number, '') = '' THEN 'none' {" ".join(f"WHEN regexp_matches(number, '{p}') THEN '{name}'" for name, p in S.STYLES)} ELSE 'arabic' END AS style FROM rated WHERE found <> 'heading' OR confidence >= 0.3)"""


@query(typed(f"WITH {ELEMENTS_SQL} SELECT * FROM e", line_no="INTEGER"))
def structure_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.elements(books(spark, sf_dir))


@query(typed(f"""WITH {ELEMENTS_SQL} SELECT a.book_id, a.line_no, a.kind, a.level, a.start, coalesce((SELECT min(b.start) FROM e b WHERE b.book_id = a.book_id AND b.line_no > a.line_no AND b.level <= a.level), (SELECT max(finish) FROM e b WHERE b.book_id = a.book_id)) AS until,
  lag(level) OVER w AS level_before, level > lag(level) OVER w + 1 AS jumps, lag(title) OVER w AS title_before FROM e a WINDOW w AS (PARTITION BY book_id ORDER BY line_no)""", line_no="INTEGER"))
def structure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.elements(books(spark, sf_dir))
    ends = structure.spans(found).select("book_id", "line_no", "start", "until")
    return structure.neighbours_of_titles(found).join(ends, ["book_id", "line_no"])


_HIERARCHY = """cs AS (SELECT book_id, kind, level, style, count(*) AS n, count(nullif(number, '')) AS numbered FROM e GROUP BY 1, 2, 3, 4), cg AS (SELECT book_id, kind, level, sum(n) AS n, max(numbered) AS most, sum(numbered) AS numbered FROM cs GROUP BY 1, 2, 3),
cc AS (SELECT book_id, coalesce(avg(CASE WHEN n >= 2 AND numbered > 0 THEN most / numbered END), 0.5) AS consistency FROM cg GROUP BY 1),
su AS (SELECT book_id, count(*) FILTER (kind = 'chapter') AS chapters, count(*) FILTER (kind IN ('section', 'subsection', 'subsubsection')) AS sections, count(*) FILTER (kind <> 'chapter') AS below, max(level) AS depth, avg(confidence) AS confidence FROM e GROUP BY 1),
h0 AS (SELECT book_id, coalesce(chapters, 0) AS chapters, coalesce(sections, 0) AS sections, coalesce(below, 0) AS below, coalesce(depth, 0) AS depth, coalesce(confidence, 0) AS confidence, coalesce(consistency, 0) AS consistency FROM books LEFT JOIN su USING (book_id) LEFT JOIN cc USING (book_id)),
h AS (SELECT *, round(CASE WHEN chapters + below = 0 THEN 0 ELSE least(1.0, 0.6 * confidence + 0.2 * consistency + CASE WHEN chapters >= 3 THEN 0.1 ELSE 0 END + CASE WHEN chapters > 0 AND below / chapters BETWEEN 1 AND 10 THEN 0.1 ELSE 0 END) END, 6) AS quality FROM h0)"""


@query(f"""WITH {ELEMENTS_SQL}, {_HIERARCHY} SELECT book_id, chapters, sections, below, depth, round(confidence, 6) AS confidence, round(consistency, 6) AS consistency, quality, chapters >= 3 AND quality >= 0.3 AS is_valid,
  concat_ws(',', CASE WHEN chapters < 3 THEN 'few_chapters' END, CASE WHEN quality < 0.3 THEN 'low_quality' END, CASE WHEN chapters > 0 AND sections / chapters < 0.5 THEN 'few_sections' END, CASE WHEN chapters > 0 AND sections / chapters > 20 THEN 'many_sections' END, CASE WHEN consistency < 0.5 THEN 'mixed_numbering' END) AS warnings FROM h""")
def structure_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    found = structure.hierarchy(rows, structure.elements(rows))
    return found.withColumns({c: F.round(c, 6) for c in ("confidence", "consistency")})


@query(f"""WITH {ELEMENTS_SQL} SELECT book_id, count(*) AS elements, count(*) FILTER (kind = 'chapter') AS chapters, count(*) FILTER (kind = 'section') AS sections, count(*) FILTER (kind = 'heading') AS headings, count(DISTINCT style) AS styles,
  count(*) FILTER (confidence > 0.8) AS high, count(*) FILTER (confidence > 0.5 AND confidence <= 0.8) AS medium, count(*) FILTER (confidence <= 0.5) AS low, round(least(1.0, sum(finish - start) / max(length(text))), 6) AS coverage, round(avg(finish - start), 4) AS mean_length
  FROM e JOIN books USING (book_id) GROUP BY 1""")
def structure_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    return structure.statistics(rows, structure.elements(rows))


_UPPER = "(upper(title) = title AND lower(title) <> title)"
_TITLE = "regexp_matches(title, '^[^A-Za-z]*[A-Z][a-z]*([^A-Za-z]+[A-Z][a-z]*)*[^A-Za-z]*$')"


@query(f"""WITH {ELEMENTS_SQL}, {_HIERARCHY}, v AS (SELECT *, CAST(nullif(regexp_extract(number, '(\\d+)', 1), '') AS BIGINT) AS value FROM e),
nv AS (SELECT *, lag(value) OVER (PARTITION BY book_id, kind, level ORDER BY line_no) AS in_group, lag(value) OVER (PARTITION BY book_id, kind ORDER BY line_no) AS in_kind FROM v WHERE value IS NOT NULL),
g AS (SELECT book_id, avg(CASE WHEN n < 2 THEN 1.0 WHEN coalesce(k, 0) < 2 THEN 0.5 ELSE hits / (k - 1) END) AS seq, coalesce(avg(CASE kind WHEN 'chapter' THEN CAST(level = 0 AS INT) WHEN 'section' THEN CAST(level = 1 AS INT) WHEN 'subsection' THEN CAST(level = 2 AS INT) END), 1.0) AS levels
  FROM (SELECT book_id, kind, level, count(*) AS n FROM v GROUP BY 1, 2, 3) LEFT JOIN (SELECT book_id, kind, level, count(*) AS k, count(*) FILTER (value = in_group + 1) AS hits FROM nv GROUP BY 1, 2, 3) USING (book_id, kind, level) GROUP BY 1),
k AS (SELECT book_id, sum(1 / styles) AS styles, count(*) AS kinds, avg(CASE WHEN n < 2 THEN 1.0 ELSE fmt / n END) AS formats, avg(CASE WHEN n < 2 THEN 1.0 WHEN coalesce(k, 0) < 2 THEN 0.5 ELSE hits / (k - 1) END) AS progress
  FROM (SELECT book_id, kind, count(*) AS n, count(DISTINCT style) AS styles, greatest(count(*) FILTER (regexp_matches(title, '^\\d')), count(*) FILTER (contains(title, ':')), count(*) FILTER ({_UPPER}), count(*) FILTER ({_TITLE})) AS fmt FROM v GROUP BY 1, 2)
  LEFT JOIN (SELECT book_id, kind, count(*) AS k, count(*) FILTER (value > in_kind) AS hits FROM nv GROUP BY 1, 2) USING (book_id, kind) GROUP BY 1),
o AS (SELECT *, CASE WHEN kind = 'chapter' THEN lead(start) OVER (PARTITION BY book_id, kind ORDER BY line_no) - finish END AS gap, lag(level) OVER w AS before, count(*) FILTER (kind = 'chapter') OVER w AS of_chapter,
  (SELECT arg_max(b.kind, b.line_no) FROM v b WHERE b.book_id = v.book_id AND b.line_no < v.line_no AND b.kind IN ('chapter', 'section')) AS up, (SELECT arg_max(b.kind, b.line_no) FROM v b WHERE b.book_id = v.book_id AND b.line_no < v.line_no AND b.kind IN ('section', 'subsection')) AS down FROM v WINDOW w AS (PARTITION BY book_id ORDER BY line_no)),
s AS (SELECT book_id, count(*) FILTER (kind = 'chapter') AS ch, count(*) FILTER (kind = 'section') AS se, count(*) FILTER (kind = 'subsection') AS sb, max(level) AS deep, avg(gap) AS gap, var_pop(gap) AS gv,
  avg(CASE WHEN kind = 'chapter' THEN 0.5 + CASE WHEN len(regexp_extract_all(title, '\\S+')) BETWEEN 5 AND 10 THEN 0.2 ELSE 0 END + CASE WHEN {_UPPER} OR {_TITLE} THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(lower(title), '{structure.GOOD_TITLES}') THEN 0.15 ELSE 0 END END) AS titles,
  avg(finish - start) FILTER (kind = 'chapter') AS cm, stddev_pop(finish - start) FILTER (kind = 'chapter') AS cd, avg(finish - start) FILTER (kind = 'section') AS sm, stddev_pop(finish - start) FILTER (kind = 'section') AS sd,
  coalesce(avg(CASE kind WHEN 'section' THEN CAST(up IS NOT DISTINCT FROM 'chapter' AS INT) WHEN 'subsection' THEN CAST(down IS NOT DISTINCT FROM 'section' AS INT) END), 1.0) AS nesting, coalesce(avg(CAST(level <= before + 1 AS INT)), 1.0) AS jumps FROM o GROUP BY 1),
d AS (SELECT book_id, sum(n) AS n, avg(CAST(n BETWEEN 1 AND 5 AS INT)) - 0.5 * avg(CAST(n > 20 AS INT)) AS spread FROM (SELECT book_id, of_chapter, count(*) FILTER (kind = 'section') AS n FROM o WHERE of_chapter > 0 GROUP BY 1, 2) GROUP BY 1),
p AS (SELECT s.book_id, ch, consistency, (styles + levels + formats + seq) / (kinds + 3) AS headings,
  CASE WHEN ch = 0 THEN 0 WHEN ch = 1 THEN (0.5 + titles + 1) / 3 ELSE (1 + (1 / (1 + gv / greatest(1.0, gap)) + least(1.0, gap / 100)) / 2 + titles + greatest(0.0, 1 - coalesce(cd / nullif(cm, 0), 0) / 0.7)) / 4 END AS boundaries,
  CASE WHEN ch = 0 AND se = 0 THEN 0.3 ELSE (CASE deep WHEN 0 THEN 0.2 WHEN 1 THEN 0.6 WHEN 2 THEN 1.0 WHEN 3 THEN 1.0 WHEN 4 THEN 0.8 ELSE 0.5 END + CASE WHEN se < 2 THEN 1.0 ELSE greatest(0.0, 1 - greatest(0.0, coalesce(sd / nullif(sm, 0), 0) - 0.5) / 0.8) END
    + CASE WHEN ch = 0 THEN 0 WHEN se = 0 THEN 0.5 WHEN coalesce(d.n, 0) = 0 THEN 0.2 ELSE greatest(0.0, spread) END + CASE WHEN se = 0 THEN 0 WHEN sb / se < 0.5 THEN 0.7 WHEN sb / se <= 3 THEN 1.0 ELSE greatest(0.0, 1 - (sb / se - 3) / 5) END) / (2 + CAST(ch > 0 AS INT) + CAST(se > 0 AS INT)) END AS organisation,
  (nesting + 1 - CASE WHEN se > 0 AND ch = 0 THEN 0.3 ELSE 0 END - CASE WHEN sb > 0 AND se = 0 THEN 0.4 ELSE 0 END + progress + jumps) / 4 AS logic FROM s JOIN g USING (book_id) JOIN k USING (book_id) LEFT JOIN d USING (book_id) JOIN cc USING (book_id)),
a AS (SELECT *, 0.4 * headings + 0.3 * boundaries + 0.2 * organisation + 0.1 * logic AS overall FROM p),
c AS (SELECT *, (CASE WHEN overall >= 0.3 THEN least(1.0, 0.7 + (overall - 0.3) * 0.3 / 0.7) ELSE least(1.0, 0.8 - (0.3 - overall) * 0.5 / 0.3) END) * CASE WHEN ch < 2 THEN 0.8 ELSE 1 END * CASE WHEN consistency < 0.5 THEN 0.9 ELSE 1 END AS sure0 FROM a)
SELECT book_id, round(headings, 5) AS headings, round(boundaries, 5) AS boundaries, round(organisation, 5) AS organisation, round(logic, 5) AS logic, round(overall, 5) AS overall, CASE WHEN abs(overall - 0.3) < 0.1 THEN 'hybrid' WHEN overall >= 0.3 THEN 'content_aware' ELSE 'fallback' END AS strategy,
  round(greatest(0.1, CASE WHEN abs(overall - 0.3) < 0.1 THEN least(sure0, 0.7) ELSE sure0 END), 5) AS sure FROM c""")
def structure_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    return structure.assessment(rows, structure.elements(rows))


@query(typed(f"""WITH {ELEMENTS_SQL}, n AS (SELECT book_id, line_no, kind, title, lead(line_no) OVER w AS next_line, lead(kind) OVER w AS next_kind, lead(start) OVER w - finish AS apart FROM e WHERE kind <> 'heading' WINDOW w AS (PARTITION BY book_id ORDER BY line_no))
SELECT book_id, line_no, next_line, CASE WHEN kind = next_kind THEN 'NEXT' ELSE 'PRECEDES' END AS link FROM n WHERE next_line IS NOT NULL AND apart <= 100""", line_no="INTEGER", next_line="INTEGER"))
def section_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters and sections linked to the next one where hardly anything lies between."""
    w = Window.partitionBy("book_id").orderBy("line_no")
    found = structure.elements(books(spark, sf_dir)).where("kind <> 'heading'")
    found = found.select("book_id", "line_no", "kind", F.lead("line_no").over(w).alias("next_line"), F.lead("kind").over(w).alias("next_kind"), (F.lead("start").over(w) - F.col("finish")).alias("apart"))
    return found.where("next_line IS NOT NULL AND apart <= 100").select("book_id", "line_no", "next_line", F.when(F.col("kind") == F.col("next_kind"), "NEXT").otherwise("PRECEDES").alias("link"))
