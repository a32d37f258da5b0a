"""Queries of the content of books: units and their classes, what is kept, and the metrics of the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import filtering
from ..operators import structure as elements
from ..operators.filtering import APPENDIX, CITATION, ESSENTIAL, ESSENTIAL_TITLE, LEADER, PREFATORY, TITLED
from .prose import _chunk_clean_sql
from .registry import query, typed
from .structure import _HIERARCHY, ELEMENTS_SQL, books

_HIT = lambda c, p: f"regexp_matches({c}, '{p}')"
_SCORE = lambda patterns, points: " + ".join(f"CASE WHEN {_HIT('part', p)} THEN {points} ELSE 0 END" for p in patterns.values())
_RULES = " ".join(f"WHEN {_HIT('low', p)} THEN '{name}|{sure}'" for name, p, sure in TITLED[1:])
_UNITS = f"""{ELEMENTS_SQL}, spans AS (SELECT book_id, start, finish, kind, title FROM e UNION ALL SELECT book_id, 0, coalesce((SELECT min(start) FROM e WHERE e.book_id = b.book_id), length(text)), NULL, NULL FROM books b),
parts0 AS (SELECT spans.*, substr(text, CAST(start AS INT) + 1, CAST(finish - start AS INT)) AS part, lower(coalesce(title, '')) AS low, list_filter(string_split(substr(text, CAST(start AS INT) + 1, CAST(finish - start AS INT)), chr(10)), lambda x: regexp_matches(x, '\\S')) AS ls FROM spans JOIN books USING (book_id) WHERE finish > start OR kind IS NOT NULL),
scored AS (SELECT *, round(least(1.0, {_SCORE(PREFATORY, 0.2)} + CASE WHEN regexp_matches(lower(part), 'isbn|publisher') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(part), 'author') AND contains(lower(part), 'biography') THEN 0.2 ELSE 0 END), 4) AS before, round(least(1.0, {_SCORE(APPENDIX, 0.25)} + CASE WHEN {_HIT('part', CITATION)} THEN 0.2 ELSE 0 END), 4) AS after,
  len(ls) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '{LEADER}'))) / greatest(len(ls), 1) > 0.3 AS leads, {_HIT('part', PREFATORY['copyright'])} AS marked FROM parts0),
tagged AS (SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN NOT regexp_matches(part, '\\S') THEN 'unknown|0' WHEN marked THEN 'copyright|0.8' WHEN leads THEN 'contents|0.7' WHEN before > after AND before > 0.5 THEN 'prefatory|' || before WHEN after > 0.5 THEN 'appendix|' || after ELSE 'core|0.6' END
  ELSE CASE WHEN marked THEN 'copyright|0.9' WHEN {_HIT('low', TITLED[0][1])} OR leads THEN 'contents|0.85' {_RULES} WHEN {_HIT('low', PREFATORY['preface'])} AND {_HIT('part', ESSENTIAL)} THEN 'core|0.7' WHEN {_HIT('low', PREFATORY['preface'])} THEN 'prefatory|0.8' WHEN kind IN ('chapter', 'section') THEN 'core|0.9'
  WHEN before > 0.6 THEN 'prefatory|' || before WHEN after > 0.6 THEN 'appendix|' || after ELSE 'core|0.5' END END AS tag FROM scored),
un AS (SELECT book_id, start, finish, kind, title, part, split_part(tag, '|', 1) AS class, CAST(split_part(tag, '|', 2) AS DOUBLE) AS sure FROM tagged),
edges AS (SELECT book_id, coalesce(min(start) FILTER (kind = 'chapter'), min(start) FILTER (class = 'core'), floor(max(finish) * 0.1)) AS core_start, coalesce(max(finish) FILTER (kind = 'chapter'), max(finish) FILTER (class = 'core'), floor(max(finish) * 0.9)) AS core_end FROM un GROUP BY 1),
st AS (SELECT un.*, CASE WHEN start < core_start THEN class = 'core' OR coalesce({_HIT('lower(title)', ESSENTIAL_TITLE)}, false) WHEN start > core_end THEN class = 'core' ELSE class <> 'copyright' END AS stays FROM un JOIN edges USING (book_id))"""


def _stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = books(spark, sf_dir)
    return filtering.retained(filtering.classified(filtering.units(rows, elements.elements(rows))))


@query(f"WITH {_UNITS} SELECT book_id, start, finish, class, round(sure, 4) AS sure, stays FROM st")
def content_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stays(spark, sf_dir).select("book_id", "start", "finish", "class", F.round("sure", 4).alias("sure"), "stays")


_FILTERED = f"""{_UNITS}, fs AS (SELECT book_id, coalesce(string_agg(regexp_replace(part, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY start) FILTER (stays AND regexp_matches(part, '\\S')), '') AS txt, count(*) AS units, count(*) FILTER (NOT stays AND class IN ('prefatory', 'copyright', 'acknowledgments', 'contents')) AS prefatory_removed,
  count(*) FILTER (NOT stays AND class IN ('appendix', 'bibliography', 'index', 'glossary')) AS appendix_removed, count(*) FILTER (stays AND class = 'core') AS core_retained FROM st GROUP BY 1),
fw AS (SELECT fs.*, text AS whole, CASE WHEN txt = '' THEN 1 WHEN length(txt) / length(text) < 0.3 THEN 2 WHEN length(txt) / length(text) < 0.5 THEN 1 ELSE 0 END AS warned, CASE WHEN txt = '' OR length(txt) / length(text) < 0.3 THEN text ELSE txt END AS kept FROM fs JOIN books USING (book_id)),
fq AS (SELECT *, length(kept) / length(whole) AS ratio FROM fw), fr AS (SELECT *, greatest(0.0, least(1.0, 0.8 + CASE WHEN ratio BETWEEN 0.5 AND 0.9 THEN 0.1 WHEN ratio < 0.3 THEN -0.3 WHEN ratio > 0.95 THEN -0.1 ELSE 0 END - warned * 0.1 + CASE WHEN prefatory_removed > 0 OR appendix_removed > 0 THEN 0.1 ELSE 0 END + CASE WHEN core_retained > 0 THEN 0.1 ELSE 0 END)) AS filtering FROM fq)"""


@query(typed(f"WITH {_FILTERED} SELECT book_id, md5(kept) AS digest, units, prefatory_removed, appendix_removed, core_retained, round(ratio, 5) AS ratio, warned AS warnings, round(filtering, 5) AS quality FROM fr", quality="DOUBLE"))
def filtered_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of each book with what was left out and how good the filter was."""
    found = filtering.filtered(books(spark, sf_dir), _stays(spark, sf_dir))
    return found.select("book_id", F.md5("text").alias("digest"), "units", "prefatory_removed", "appendix_removed", "core_retained", F.round("ratio", 5).alias("ratio"), "warnings", F.round("quality", 5).alias("quality"))


@query(typed(f"""WITH {_FILTERED}, {_HIERARCHY}, cl AS (SELECT book_id, text, {_chunk_clean_sql(5)} AS c FROM books), cq AS (SELECT book_id, CASE WHEN c = '' THEN 0 ELSE greatest(0.0, least(1.0, 1.0 - CASE WHEN length(c) / length(text) < 0.5 THEN 0.3 WHEN length(c) / length(text) < 0.8 THEN 0.1 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(c, '[.!?]+')) * 100 / len(regexp_extract_all(c, '[^\\x20\\x09-\\x0D]+')) BETWEEN 5 AND 20 THEN 0.1 ELSE 0 END + CASE WHEN contains(c, chr(10) || chr(10)) THEN 0.05 ELSE 0 END)) END AS cleaning FROM cl),
pm AS (SELECT book_id, chapters, sections, below, depth, confidence, consistency, quality, ratio, cleaning, 0.225 + 0.2 * cleaning + 0.3 * quality + 0.25 * filtering AS overall FROM h JOIN fr USING (book_id) JOIN cq USING (book_id))
SELECT book_id, round(overall, 5) AS overall, round(least(1.0, 0.5 + CASE WHEN chapters >= 3 THEN 0.2 WHEN chapters > 0 THEN 0.1 ELSE 0 END + CASE WHEN sections > 0 THEN 0.1 ELSE 0 END + CASE WHEN depth > 0 THEN 0.1 ELSE 0 END + 0.1 * consistency), 5) AS validity,
  round(CASE WHEN chapters + below = 0 THEN 0 ELSE least(1.0, least(1.0, (chapters + below) / 10) + CASE WHEN depth > 1 THEN 0.1 ELSE 0 END) END, 5) AS completeness, round(greatest(0.0, least(1.0, 0.5 + 0.3 * cleaning + 0.2 * confidence)), 5) AS coherence,
  round(least(1.0, 0.6 + CASE WHEN chapters >= 3 THEN 0.2 ELSE 0 END + CASE WHEN sections > 0 AND sections / greatest(1, chapters) BETWEEN 1 AND 10 THEN 0.1 ELSE 0 END + CASE WHEN ratio > 0.6 THEN 0.1 ELSE 0 END), 5) AS value, ratio >= 0.5 AS retained, quality >= 0.5 AS coherent,
  CASE WHEN overall < 0.7 THEN 'validation_failed' WHEN chapters < 3 OR quality < 0.3 OR (chapters > 0 AND (sections / chapters < 0.5 OR sections / chapters > 20)) OR consistency < 0.5 THEN 'partial_success' ELSE 'success' END AS status FROM pm""", value="DOUBLE"))
def book_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning, structure and filter of each book in one row of metrics, and its status."""
    found = filtering.pipeline(books(spark, sf_dir))
    return found.select("book_id", *(F.round(c, 5).alias(c) for c in ("overall", "validity", "completeness", "coherence", "value")), "retained", "coherent", "status")
