"""Structure of books: elements from lines, their ends, hierarchy measures, validation and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structure import FIELDS, clamped, pattern_of, stripped, with_fields
from .lineage import cut

LEAST_CHAPTERS = 3
LEAST_QUALITY = 0.3
DEEPEST = 3
#: Score from which chunking follows the structure.
CONTENT_AWARE = 0.3
#: Words of good chapter titles.
GOOD_TITLES = "introduction|overview|fundamentals|advanced|principles|concepts|theory|practice|applications"
SECTION_KINDS = ("section", "subsection", "subsubsection")


def elements(books: DataFrame) -> DataFrame:
    """Elements of books (book_id, text): line_no, start, finish and the fields of structure lines.

    An element ends where the next one starts, the last one with the text.  Lines are classified before they are
    shuffled by book, and of other lines only their length is.
    """
    rows = books.select("book_id", F.length("text").alias("size"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.select("book_id", "size", "line_no", F.length("raw").alias("n"), stripped(F.col("raw")).alias("line"))
    rows = rows.withColumn("pattern", pattern_of(F.col("line"))).withColumn("line", F.when(F.col("pattern").isNotNull(), F.col("line")))
    by_line = Window.partitionBy("book_id").orderBy("line_no")
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("n") + 1).over(by_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = rows.where("pattern IS NOT NULL").withColumn("finish", F.coalesce(F.lead("start").over(by_line), F.col("size").cast("long")))
    return with_fields(found).select("book_id", "line_no", "start", "finish", *FIELDS)


def spans(found: DataFrame) -> DataFrame:
    """Elements with `until`: where the next one of the same or a higher level starts, or the last one ends."""
    after = Window.partitionBy("book_id").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("book_id")
    until = F.lit(None).cast("long")
    for level in range(DEEPEST + 1):
        next_start = F.min(F.when(F.col("level") <= level, F.col("start"))).over(after)
        until = F.when(F.col("level") == level, next_start).otherwise(until)
    return found.withColumn("until", F.coalesce(until, F.max("finish").over(whole)))


def numbering_consistency(found: DataFrame) -> DataFrame:
    """For each book the mean share of the commonest style in the groups of kind and level that have two elements or more; 0.5 without any."""
    styles = found.groupBy("book_id", "kind", "level", "style").agg(F.count("*").alias("n"), F.count(F.when(F.coalesce(F.col("number"), F.lit("")) != "", 1)).alias("numbered"))
    groups = styles.groupBy("book_id", "kind", "level").agg(F.sum("n").alias("n"), F.max("numbered").alias("most"), F.sum("numbered").alias("numbered"))
    share = F.when((F.col("n") >= 2) & (F.col("numbered") > 0), F.col("most") / F.col("numbered"))
    return groups.groupBy("book_id").agg(F.coalesce(F.avg(share), F.lit(0.5)).alias("consistency"))


def hierarchy(books: DataFrame, found: DataFrame) -> DataFrame:
    """A row per book: chapters, sections, depth, consistency, confidence, quality, is_valid and warnings."""
    chapter, section = F.col("kind") == "chapter", F.col("kind").isin(*SECTION_KINDS)
    sums = found.groupBy("book_id").agg(F.count(F.when(chapter, 1)).alias("chapters"), F.count(F.when(section, 1)).alias("sections"), F.count(F.when(~chapter, 1)).alias("below"), F.max("level").alias("depth"), F.avg("confidence").alias("confidence"))
    rows = books.select("book_id").join(sums.join(numbering_consistency(found), "book_id"), "book_id", "left")
    rows = rows.fillna(0, ["chapters", "sections", "below", "depth", "confidence", "consistency"])
    ratio = F.try_divide("below", "chapters")
    quality = 0.6 * F.col("confidence") + 0.2 * F.col("consistency") + F.when(F.col("chapters") >= LEAST_CHAPTERS, 0.1).otherwise(0.0) + F.when(ratio.between(1, 10), 0.1).otherwise(0.0)
    rows = rows.withColumn("quality", F.round(F.when(F.col("chapters") + F.col("below") > 0, clamped(quality)).otherwise(0.0), 6))
    per_chapter = F.try_divide("sections", "chapters")
    warnings = _named(few_chapters=F.col("chapters") < LEAST_CHAPTERS, low_quality=F.col("quality") < LEAST_QUALITY, few_sections=per_chapter < 0.5, many_sections=per_chapter > 20, mixed_numbering=F.col("consistency") < 0.5)
    return rows.withColumn("is_valid", (F.col("chapters") >= LEAST_CHAPTERS) & (F.col("quality") >= LEAST_QUALITY)).withColumn("warnings", warnings)


def _named(**conditions: Column) -> Column:
    """The names of the conditions that hold, with commas between."""
    return F.concat_ws(",", *(F.when(c, name) for name, c in conditions.items()))


def statistics(books: DataFrame, found: DataFrame) -> DataFrame:
    """A row per book with an element: numbers by kind, numbered ones, by band of confidence, covered share and mean length."""
    size = F.col("finish") - F.col("start")
    rows = found.join(books.select("book_id", F.length("text").alias("characters")), "book_id")
    return rows.groupBy("book_id").agg(
        F.count("*").alias("elements"),
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}s") for k in ("chapter", "section", "heading")),
        F.count_distinct("style").alias("styles"),
        F.count(F.when(F.col("confidence") > 0.8, 1)).alias("high"),
        F.count(F.when((F.col("confidence") > 0.5) & (F.col("confidence") <= 0.8), 1)).alias("medium"),
        F.count(F.when(F.col("confidence") <= 0.5, 1)).alias("low"),
        F.round(F.least(F.lit(1.0), F.sum(size) / F.max("characters")), 6).alias("coverage"),
        F.round(F.avg(size), 4).alias("mean_length"),
    )


def neighbours_of_titles(found: DataFrame) -> DataFrame:
    """Elements with the level and title of the one before in the book, and whether the level goes up by more than one."""
    w = Window.partitionBy("book_id").orderBy("line_no")
    before = F.lag("level").over(w)
    return found.select("book_id", "line_no", "kind", "level", before.alias("level_before"), (F.col("level") > before + 1).alias("jumps"), F.lag("title").over(w).alias("title_before"))


def assessment(books: DataFrame, found: DataFrame) -> DataFrame:
    """How well the structure of each book that has one would serve for chunking: the parts of the score, the whole, the strategy and its confidence.

    One aggregation by (book, kind, level), three by book; nothing but elements is shuffled.
    """
    found = cut(found)  # elements are few, texts are not
    w = Window.partitionBy("book_id").orderBy("line_no")
    by_kind, by_group = Window.partitionBy("book_id", "kind").orderBy("line_no"), Window.partitionBy("book_id", "kind", "level").orderBy("line_no")
    number = F.nullif(F.regexp_extract("number", r"(\d+)", 1), F.lit("")).cast("long")
    rows = found.withColumn("value", number)
    numbered = rows.where("value IS NOT NULL").withColumn("in_group", F.lag("value").over(by_group)).withColumn("in_kind", F.lag("value").over(by_kind))
    title = F.col("title")
    formats = (title.rlike(r"^\d"), title.contains(":"), (F.upper(title) == title) & (F.lower(title) != title), title.rlike("^[^A-Za-z]*[A-Z][a-z]*([^A-Za-z]+[A-Z][a-z]*)*[^A-Za-z]*$"))
    # Each group of kind and level: how many numbers follow the one before.
    steps = numbered.groupBy("book_id", "kind", "level").agg(F.count("*").alias("k"), F.count(F.when(F.col("value") == F.col("in_group") + 1, 1)).alias("hits"))
    groups = rows.groupBy("book_id", "kind", "level").agg(F.count("*").alias("n")).join(steps, ["book_id", "kind", "level"], "left").fillna(0, ["k", "hits"])
    in_order = F.when(F.col("n") < 2, 1.0).when(F.col("k") < 2, 0.5).otherwise(F.col("hits") / (F.col("k") - 1))
    wanted = F.when(F.col("kind") == "chapter", 0).when(F.col("kind") == "section", 1).when(F.col("kind") == "subsection", 2)
    groups = groups.groupBy("book_id").agg(F.avg(in_order).alias("sequence"), F.coalesce(F.avg((F.col("level") == wanted).cast("int")), F.lit(1.0)).alias("levels"))
    # Each kind: styles, formats of titles, ascending numbers.
    steps = numbered.groupBy("book_id", "kind").agg(F.count("*").alias("k"), F.count(F.when(F.col("value") > F.col("in_kind"), 1)).alias("hits"))
    kinds = rows.groupBy("book_id", "kind").agg(F.count("*").alias("n"), F.count_distinct("style").alias("styles"), F.greatest(*(F.sum(f.cast("int")) for f in formats)).alias("format"))
    kinds = kinds.join(steps, ["book_id", "kind"], "left").fillna(0, ["k", "hits"])
    kinds = kinds.groupBy("book_id").agg(
        F.sum(1 / F.col("styles")).alias("styles"), F.count("*").alias("kinds"), F.avg(F.when(F.col("n") < 2, 1.0).otherwise(F.col("format") / F.col("n"))).alias("formats"),
        F.avg(F.when(F.col("n") < 2, 1.0).when(F.col("k") < 2, 0.5).otherwise(F.col("hits") / (F.col("k") - 1))).alias("progress"))
    # Each book: chapters, sections and their lengths.
    size, words = F.col("finish") - F.col("start"), F.regexp_count(title, F.lit(r"\S+"))
    good = 0.5 + F.when(words.between(5, 10), 0.2).otherwise(0.0) + F.when(formats[2] | formats[3], 0.15).otherwise(0.0) + F.when(F.lower(title).rlike(GOOD_TITLES), 0.15).otherwise(0.0)
    chapter, section = F.col("kind") == "chapter", F.col("kind") == "section"
    rows = rows.withColumn("gap", F.when(chapter, F.lead("start").over(by_kind) - F.col("finish"))).withColumn("last_upper", F.last(F.when(F.col("kind").isin("chapter", "section"), F.col("kind")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("last_lower", F.last(F.when(F.col("kind").isin("section", "subsection"), F.col("kind")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("before", F.lag("level").over(w)).withColumn("of_chapter", F.count(F.when(chapter, 1)).over(w))
    nested = F.when(section, F.col("last_upper").eqNullSafe("chapter")).when(F.col("kind") == "subsection", F.col("last_lower").eqNullSafe("section"))
    sums = rows.groupBy("book_id").agg(
        F.count(F.when(chapter, 1)).alias("chapters"), F.count(F.when(section, 1)).alias("plain_sections"), F.count(F.when(F.col("kind") == "subsection", 1)).alias("subsections"), F.max("level").alias("depth"),
        F.avg("gap").alias("gap"), F.var_pop("gap").alias("gap_spread"), F.avg(F.when(chapter, good)).alias("titles"),
        F.avg(F.when(chapter, size)).alias("chapter_mean"), F.stddev_pop(F.when(chapter, size)).alias("chapter_spread"), F.avg(F.when(section, size)).alias("section_mean"), F.stddev_pop(F.when(section, size)).alias("section_spread"),
        F.coalesce(F.avg(nested.cast("int")), F.lit(1.0)).alias("nesting"), F.coalesce(F.avg((F.col("level") <= F.col("before") + 1).cast("int")), F.lit(1.0)).alias("jumps"))
    per_chapter = rows.where("of_chapter > 0").groupBy("book_id", "of_chapter").agg(F.count(F.when(section, 1)).alias("n"))
    spread = per_chapter.groupBy("book_id").agg(F.sum("n").alias("in_chapters"), (F.avg(F.col("n").between(1, 5).cast("int")) - 0.5 * F.avg((F.col("n") > 20).cast("int"))).alias("spread"))
    rows = sums.join(groups, "book_id").join(kinds, "book_id").join(spread, "book_id", "left").join(hierarchy(books, found).select("book_id", "consistency"), "book_id")
    headings = (F.col("styles") + F.col("levels") + F.col("formats") + F.col("sequence")) / (F.col("kinds") + 3)
    spacing = (1 / (1 + F.col("gap_spread") / F.greatest(F.lit(1.0), F.col("gap"))) + F.least(F.lit(1.0), F.col("gap") / 100)) / 2
    even = F.when(F.col("chapters") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide("chapter_spread", "chapter_mean"), F.lit(0.0)) / 0.7))
    boundaries = F.when(F.col("chapters") == 0, 0.0).otherwise((F.least(F.lit(1.0), F.col("chapters") / 2) + F.when(F.col("chapters") > 1, spacing).otherwise(0.0) + F.col("titles") + even) / F.when(F.col("chapters") > 1, 4).otherwise(3))
    distribution = F.when((F.col("chapters") == 0) | (F.col("plain_sections") == 0), 0.5).when(F.coalesce("in_chapters", F.lit(0)) == 0, 0.2).otherwise(F.greatest(F.lit(0.0), "spread"))
    depth = F.when(F.col("depth") == 0, 0.2).when(F.col("depth") == 1, 0.6).when(F.col("depth") <= 3, 1.0).when(F.col("depth") == 4, 0.8).otherwise(0.5)
    ratio = F.try_divide("subsections", "plain_sections")
    share = F.when(ratio.between(0.5, 3.0), 1.0).when(ratio < 0.5, 0.7).otherwise(F.greatest(F.lit(0.0), 1 - (ratio - 3) / 5))
    balance = F.when(F.col("plain_sections") < 2, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(F.lit(0.0), F.coalesce(F.try_divide("section_spread", "section_mean"), F.lit(0.0)) - 0.5) / 0.8))
    some_chapters, some_sections = F.col("chapters") > 0, F.col("plain_sections") > 0
    parts = depth + balance + F.when(some_chapters, distribution).otherwise(0.0) + F.when(some_sections, share).otherwise(0.0)
    organised = F.when(~some_chapters & ~some_sections, 0.3).otherwise(parts / (2 + some_chapters.cast("int") + some_sections.cast("int")))
    orphans = 1 - F.when(some_sections & ~some_chapters, 0.3).otherwise(0.0) - F.when((F.col("subsections") > 0) & ~some_sections, 0.4).otherwise(0.0)
    logic = (F.col("nesting") + orphans + F.col("progress") + F.col("jumps")) / 4
    scores = {"headings": headings, "boundaries": boundaries, "organisation": organised, "logic": logic}
    rows = rows.select("book_id", "chapters", "consistency", *(c.alias(name) for name, c in scores.items()))
    overall = 0.4 * F.col("headings") + 0.3 * F.col("boundaries") + 0.2 * F.col("organisation") + 0.1 * F.col("logic")
    rows = rows.withColumn("overall", overall)
    above = F.col("overall") >= CONTENT_AWARE
    sure = F.when(above, F.least(F.lit(1.0), 0.7 + (F.col("overall") - CONTENT_AWARE) * 0.3 / (1 - CONTENT_AWARE))).otherwise(F.least(F.lit(1.0), 0.8 - (CONTENT_AWARE - F.col("overall")) * 0.5 / CONTENT_AWARE))
    sure = sure * F.when(F.col("chapters") < 2, 0.8).otherwise(1.0) * F.when(F.col("consistency") < 0.5, 0.9).otherwise(1.0)
    near = F.abs(F.col("overall") - CONTENT_AWARE) < 0.1
    strategy = F.when(near, "hybrid").when(above, "content_aware").otherwise("fallback")
    return rows.select("book_id", *(F.round(c, 5).alias(c) for c in (*scores, "overall")), strategy.alias("strategy"), F.round(F.greatest(F.lit(0.1), F.when(near, F.least(sure, F.lit(0.7))).otherwise(sure)), 5).alias("sure"))
