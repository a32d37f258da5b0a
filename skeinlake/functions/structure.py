"""Lines of books as elements of their structure: chapters, sections and headings, told by patterns, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TITLED = r"(?:\s*[:.\-]\s*(.+?))?$"
#: Patterns of chapters, of sections and of headings, in the order in which they are tried, each with its confidence.
CHAPTERS = [
    ("standard", r"(?i)^(?:chapter|ch\.?)\s*(\d+)" + _TITLED, 0.9),
    ("unit", r"(?i)^unit\s+(\d+)" + _TITLED, 0.85),
    ("part", r"(?i)^part\s+([ivxlcdm]+|\d+)" + _TITLED, 0.8),
    ("numbered_simple", r"^(\d+)\s*[:.\-]\s*(.+?)$", 0.6),
    ("roman_numbered", r"^([IVXLCDM]+)\.\s*(.+?)$", 0.7),
    ("lesson", r"(?i)^lesson\s+(\d+)" + _TITLED, 0.75),
    ("module", r"(?i)^module\s+(\d+)" + _TITLED, 0.75),
]
SECTIONS = [
    ("decimal", r"^(\d+\.\d+)(?:\.\d+)*\s+(.+?)$", 0.85),
    ("letter_section", r"^([A-Z])\.\s*(.+?)$", 0.7),
    ("numbered_section", r"^(\d+\.\d+)\s+(.+?)$", 0.8),
    ("subsection", r"^(\d+\.\d+\.\d+)\s+(.+?)$", 0.9),
    ("roman_section", r"^([ivxlcdm]+)\.\s*(.+?)$", 0.65),
]
HEADINGS = [("title_case", r"^([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\s*$", 0.6), ("all_caps", r"^([A-Z\s]{4,})\s*$", 0.5), ("bold_indicators", r"^(?:\*\*(.+?)\*\*|\*(.+?)\*)", 0.7)]
CHAPTER_WORDS = "introduction|overview|conclusion|summary"
HEADING_WORDS = "introduction|overview|definition|example|exercise|summary|conclusion"
#: Numbering styles, in the order in which they are tried.
STYLES = [("arabic", r"^\d+$"), ("roman_upper", "^[IVXLCDM]+$"), ("roman_lower", "^[ivxlcdm]+$"), ("letter_upper", "^[A-Z]$"), ("letter_lower", "^[a-z]$"), ("decimal", r"\.")]

FIELDS = ("kind", "pattern", "number", "title", "level", "confidence", "style")


def stripped(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s+|\s+$", "")


def clamped(x: Column) -> Column:
    """Between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def numbering_style(number: Column) -> Column:
    out = F.when(F.coalesce(number, F.lit("")) == "", "none")
    for name, pattern in STYLES:
        out = out.when(number.rlike(pattern), name)
    return out.otherwise("arabic")


def section_number(title: Column) -> Column:
    """Leading number with dots, or null."""
    return F.nullif(F.regexp_extract(title, r"^(\d+(?:\.\d+)*)", 1), F.lit(""))


def pattern_of(line: Column) -> Column:
    """The name of the first pattern that a stripped line matches, or null.  Chapters go before sections, these before headings."""
    out = F.when(F.length(line) < 2, F.lit(None).cast("string"))
    for name, pattern, _ in CHAPTERS + SECTIONS:
        out = out.when(line.rlike(pattern), name)
    for name, pattern, _ in HEADINGS:
        out = out.when(F.length(line).between(3, 200) & line.rlike(pattern), name)
    return out


def with_fields(rows: DataFrame, line: str = "line", pattern: str = "pattern") -> DataFrame:
    """Adds the other FIELDS to rows of lines and their patterns."""
    text, name = F.col(line), F.col(pattern)
    by_name = lambda value: F.create_map(*(F.lit(x) for n, _, b in CHAPTERS + SECTIONS + HEADINGS for x in (n, value(n, b))))[name]
    kinds = {n: kind for kind, some in (("chapter", CHAPTERS), ("section", SECTIONS), ("heading", HEADINGS)) for n, _, _ in some}

    def group(n: int) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for known, expression, _ in CHAPTERS + SECTIONS:
            out = out.when(name == known, F.regexp_extract(text, expression, n))
        return out

    rows = rows.withColumns({"number": group(1), "title": stripped(group(2)), "kind": by_name(lambda n, b: kinds[n]), "base": by_name(lambda n, b: b), "n_words": F.regexp_count(text, F.lit(r"\S+"))})
    n, low, size, words = F.col("number"), F.lower(text), F.length(text), F.col("n_words")
    zero = F.lit(0.0)
    chapter = F.when(n.rlike(r"^\d+$"), 0.05).otherwise(0.0) - F.when(size < 5, 0.2).when(size > 100, 0.1).otherwise(0.0) + F.when(low.rlike(CHAPTER_WORDS), 0.05).otherwise(zero)
    section = F.when(n.rlike(r"^\d+(\.\d+)+$"), 0.05).otherwise(0.0) - F.when(words < 2, 0.15).otherwise(zero)
    heading = F.when(words.between(2, 10), 0.1).when(words > 20, -0.2).otherwise(0.0) + F.when(low.rlike(HEADING_WORDS), 0.1).otherwise(zero)
    level = F.when(F.col("kind") == "chapter", 0).when(name == "subsection", 2).when(name == "decimal", F.greatest(F.lit(1), F.regexp_count(n, F.lit(r"\.")))).otherwise(1)
    more = F.when(F.col("kind") == "chapter", chapter).when(F.col("kind") == "section", section).otherwise(heading)
    rows = rows.withColumns({"level": level, "confidence": F.round(clamped(F.col("base") + more), 4), "title": F.when(F.coalesce(F.col("title"), F.lit("")) == "", text).otherwise(F.col("title")), "style": numbering_style(n)})
    return rows.withColumn("kind", F.when((F.col("kind") == "section") & (F.col("level") == 2), "subsection").when((F.col("kind") == "section") & (F.col("level") == 3), "subsubsection").otherwise(F.col("kind"))).drop("base", "n_words")
