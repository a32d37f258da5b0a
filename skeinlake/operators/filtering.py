"""What of a book is its content: units of the structure told apart by titles and texts, kept or left out, and the quality of the outcome."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import clamped
from . import structure

_ALONE = r"(?im)(?:^|\n)\s*(?:{})\s*(?:\n|$)"
#: Signs of what comes before the content, and of what comes after it.
PREFATORY = {
    "copyright": r"(?im)(?:copyright|©|\(c\))\s*\d{4}",
    "contents": _ALONE.format(r"table\s+of\s+contents|contents"),
    "preface": _ALONE.format("preface|foreword|introduction"),
    "acknowledgments": _ALONE.format("acknowledgment?s?|thanks?"),
    "author": _ALONE.format(r"about\s+the\s+author|author\s+biography"),
    "publisher": r"(?im)(?:published\s+by|publisher|printing|edition|isbn)",
}
APPENDIX = {
    "appendix": _ALONE.format(r"appendix\s*[a-z]?|appendices"),
    "bibliography": _ALONE.format(r"bibliography|references|works?\s+cited"),
    "index": _ALONE.format(r"index|subject\s+index"),
    "glossary": _ALONE.format("glossary|terms|definitions"),
    "answers": _ALONE.format(r"answer\s+key|solutions|answers"),
}
ESSENTIAL = r"(?i)(?:learning\s+objectives?|objectives?|goals?|outcomes?|overview|summary|key\s+concepts?|prerequisites?|requirements?|background)"
ESSENTIAL_TITLE = "objective|goal|overview|prerequisite"
CITATION = r"\[\d+\]|\(\d{4}\)|et\s+al\."
#: Words, in small letters, of which a text has one if it has the sign at all: patterns are tried only then.
NEEDED = {
    "copyright": ("copyright", "©", "(c)"), "contents": ("contents",), "preface": ("preface", "foreword", "introduction"), "acknowledgments": ("acknowledgmen", "thank"), "author": ("author",), "publisher": ("publish", "printing", "edition", "isbn"),
    "appendix": ("appendi",), "bibliography": ("bibliography", "references", "cited"), "index": ("index",), "glossary": ("glossary", "terms", "definitions"), "answers": ("answer", "solutions"),
}
LEADER = r"^\s*.+?\.{3,}\s*\d+\s*$"
#: Classes that a title tells, in the order in which they are tried, with their confidence.
TITLED = [("contents", PREFATORY["contents"], 0.85), ("acknowledgments", PREFATORY["acknowledgments"], 0.8), ("bibliography", APPENDIX["bibliography"], 0.9), ("index", APPENDIX["index"], 0.85), ("glossary", APPENDIX["glossary"], 0.8), ("appendix", APPENDIX["appendix"], 0.85)]
BEFORE = ("prefatory", "copyright", "acknowledgments", "contents")
AFTER = ("appendix", "bibliography", "index", "glossary")


def _any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def has_sign(text: Column, low: Column, name: str) -> Column:
    """Whether a text, also given in small letters, has the sign of this name."""
    return _any(low, NEEDED[name]) & text.rlike((PREFATORY | APPENDIX)[name])


def _sum(text: Column, low: Column, names: Iterable[str], points: float) -> Column:
    return sum((F.when(has_sign(text, low, n), points).otherwise(0.0) for n in names), F.lit(0.0))


def prefatory_score(text: Column, low: Column) -> Column:
    more = F.when(_any(low, ("isbn", "publisher")), 0.3).otherwise(0.0) + F.when(low.contains("author") & low.contains("biography"), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), _sum(text, low, PREFATORY, 0.2) + more)


def appendix_score(text: Column, low: Column) -> Column:
    return F.least(F.lit(1.0), _sum(text, low, APPENDIX, 0.25) + F.when(_any(text, ("[", "(", "al.")) & text.rlike(CITATION), 0.2).otherwise(0.0))


def is_contents(text: Column) -> Column:
    """More than three tenths of the lines lead by dots to a number."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    return text.contains("...") & (F.size(lines) > 0) & (F.size(F.filter(lines, lambda x: x.rlike(LEADER))) / F.size(lines) > 0.3)


def units(books: DataFrame, found: DataFrame) -> DataFrame:
    """book_id, start, finish, kind, title, part of the elements, of the text before the first one, and of a book without any (kind null)."""
    first = found.groupBy("book_id").agg(F.min("start").alias("first"))
    ends = books.select("book_id", F.length("text").cast("long").alias("size")).join(first, "book_id", "left")
    gaps = ends.select("book_id", F.lit(0).cast("long").alias("start"), F.coalesce("first", "size").alias("finish"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("title")).where("finish > 0")
    rows = found.select("book_id", "start", "finish", "kind", "title").unionByName(gaps)
    return rows.join(books, "book_id").select("book_id", "start", "finish", "kind", "title", F.expr("substring(text, start + 1, finish - start)").alias("part"))


def classified(rows: DataFrame) -> DataFrame:
    """Units with their class and how sure it is; rules are tried in order."""
    part, low = F.col("part"), F.lower(F.coalesce("title", F.lit("")))
    rows = rows.withColumn("_low", F.lower(part))
    rows = rows.withColumns({"before": F.round(prefatory_score(part, F.col("_low")), 4), "after": F.round(appendix_score(part, F.col("_low")), 4), "leads": is_contents(part), "marked": has_sign(part, F.col("_low"), "copyright")}).drop("_low")
    before, after, gap = F.col("before"), F.col("after"), F.col("kind").isNull()
    loose = [(~part.rlike(r"\S"), "unknown", F.lit(0.0)), (F.col("marked"), "copyright", F.lit(0.8)), (F.col("leads"), "contents", F.lit(0.7)), ((before > after) & (before > 0.5), "prefatory", before), (after > 0.5, "appendix", after)]
    fixed = [(F.col("marked"), "copyright", F.lit(0.9)), (low.rlike(TITLED[0][1]) | F.col("leads"), "contents", F.lit(0.85))]
    fixed += [(low.rlike(p), name, F.lit(sure)) for name, p, sure in TITLED[1:]]
    preface = low.rlike(PREFATORY["preface"])
    fixed += [(preface & part.rlike(ESSENTIAL), "core", F.lit(0.7)), (preface, "prefatory", F.lit(0.8)), (F.col("kind").isin("chapter", "section"), "core", F.lit(0.9)), (before > 0.6, "prefatory", before), (after > 0.6, "appendix", after)]

    def chain(rules: list, what: int, other: Column) -> Column:
        out = F.when(F.lit(False), other)
        for rule in rules:
            out = out.when(rule[0], F.lit(rule[1]) if what == 1 else rule[2])
        return out.otherwise(other)

    rows = rows.withColumn("class", F.when(gap, chain(loose, 1, F.lit("core"))).otherwise(chain(fixed, 1, F.lit("core"))))
    return rows.withColumn("sure", F.when(gap, chain(loose, 2, F.lit(0.6))).otherwise(chain(fixed, 2, F.lit(0.5)))).drop("before", "after", "leads", "marked")


def retained(rows: DataFrame) -> DataFrame:
    """Classified units with `stays`: core units, those with essential titles before the content, and all but copyright notices inside it.

    The content reaches from the first chapter to the end of the last one; without chapters, over the core units, else over the
    middle eight tenths.
    """
    w = Window.partitionBy("book_id")
    chapter, core = F.col("kind") == "chapter", F.col("class") == "core"
    edge = lambda f, c, part: F.coalesce(f(F.when(chapter, F.col(c))).over(w), f(F.when(core, F.col(c))).over(w), F.floor(F.max("finish").over(w) * part))
    rows = rows.withColumns({"core_start": edge(F.min, "start", 0.1), "core_end": edge(F.max, "finish", 0.9)})
    essential = F.coalesce(F.lower("title").rlike(ESSENTIAL_TITLE), F.lit(False))
    stays = F.when(F.col("start") < F.col("core_start"), core | essential).when(F.col("start") > F.col("core_end"), core).otherwise(F.col("class") != "copyright")
    return rows.withColumn("stays", stays)


def filtered(books: DataFrame, rows: DataFrame) -> DataFrame:
    """book_id, text, units, prefatory_removed, appendix_removed, core_retained, ratio, warnings, quality: the units that stay, or the whole text if they are too few."""
    stays, kind = F.col("stays"), F.col("class")
    trimmed = F.regexp_replace("part", r"^\s+|\s+$", "")
    count = lambda c: F.count(F.when(c, 1))
    sums = rows.groupBy("book_id").agg(
        F.array_sort(F.collect_list(F.when(stays & (trimmed != ""), F.struct("start", trimmed.alias("t"))))).alias("kept"), F.count("*").alias("units"), count(~stays & kind.isin(*BEFORE)).alias("prefatory_removed"), count(~stays & kind.isin(*AFTER)).alias("appendix_removed"), count(stays & (kind == "core")).alias("core_retained"))
    sums = sums.join(books.withColumnRenamed("text", "whole"), "book_id").withColumn("text", F.array_join(F.transform("kept", lambda k: k["t"]), "\n\n"))
    share = F.length("text") / F.length("whole")
    warnings = F.when(F.col("text") == "", 1).when(share < 0.3, 2).when(share < 0.5, 1).otherwise(0)
    sums = sums.withColumn("warnings", warnings).withColumn("text", F.when((F.col("text") == "") | (share < 0.3), F.col("whole")).otherwise(F.col("text")))
    ratio = F.length("text") / F.length("whole")
    quality = 0.8 + F.when(ratio.between(0.5, 0.9), 0.1).when(ratio < 0.3, -0.3).when(ratio > 0.95, -0.1).otherwise(0.0) - F.col("warnings") * 0.1
    quality = quality + F.when((F.col("prefatory_removed") > 0) | (F.col("appendix_removed") > 0), 0.1).otherwise(0.0) + F.when(F.col("core_retained") > 0, 0.1).otherwise(0.0)
    return sums.select("book_id", "text", "units", "prefatory_removed", "appendix_removed", "core_retained", ratio.alias("ratio"), "warnings", clamped(quality).alias("quality"))


def pipeline(books: DataFrame) -> DataFrame:
    """Metrics of books from cleaning, structure and filter: scores, weighted whole, flags, and the status that they give."""
    from ..functions.prose import chunk_clean, cleaning_quality

    from .lineage import cut

    books = cut(books)  # read more than once
    found = cut(structure.elements(books))
    measured = structure.hierarchy(books, found).withColumnRenamed("quality", "structure")
    kept = filtered(books, retained(classified(units(books, found)))).withColumnRenamed("quality", "filtering").drop("text", "warnings")
    clean = books.select("book_id", "text", chunk_clean(F.col("text"), 5).alias("clean")).select("book_id", cleaning_quality(F.col("text"), F.col("clean"), F.lit(0)).alias("cleaning"))
    rows = measured.join(kept, "book_id").join(clean, "book_id")
    n, sections = F.col("chapters"), F.col("sections")
    elements = n + F.col("below")
    overall = 0.25 * F.lit(0.9) + 0.2 * F.col("cleaning") + 0.3 * F.col("structure") + 0.25 * F.col("filtering")
    validity = F.least(F.lit(1.0), 0.5 + F.when(n >= 3, 0.2).when(n > 0, 0.1).otherwise(0.0) + F.when(sections > 0, 0.1).otherwise(0.0) + F.when(F.col("depth") > 0, 0.1).otherwise(0.0) + 0.1 * F.col("consistency"))
    completeness = F.when(elements == 0, 0.0).otherwise(F.least(F.lit(1.0), F.least(F.lit(1.0), elements / 10) + F.when(F.col("depth") > 1, 0.1).otherwise(0.0)))
    coherence = clamped(0.5 + 0.3 * F.col("cleaning") + 0.2 * F.col("confidence"))
    per_chapter = sections / F.greatest(F.lit(1), n)
    value = F.least(F.lit(1.0), 0.6 + F.when(n >= 3, 0.2).otherwise(0.0) + F.when((sections > 0) & per_chapter.between(1, 10), 0.1).otherwise(0.0) + F.when(F.col("ratio") > 0.6, 0.1).otherwise(0.0))
    rows = rows.withColumn("overall", overall)
    status = F.when(F.col("overall") < 0.7, "validation_failed").when((n < 3) | (F.col("warnings") != ""), "partial_success").otherwise("success")
    return rows.select("book_id", "overall", validity.alias("validity"), completeness.alias("completeness"), coherence.alias("coherence"), value.alias("value"), (F.col("ratio") >= 0.5).alias("retained"), (F.col("structure") >= 0.5).alias("coherent"), status.alias("status"))
