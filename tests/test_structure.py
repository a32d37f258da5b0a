"""Worked examples of lines, numbering and classes of content, independent of the SQL beside the queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import structure as S
from skeinlake.operators import filtering, structure

LINES = {
    "Chapter 1: Introduction": ("chapter", "standard", "1", "Introduction", 0, 1.0, "arabic"),
    "CH. 7": ("chapter", "standard", "7", "CH. 7", 0, 0.95, "arabic"),
    "Part IV - The end": ("chapter", "part", "IV", "The end", 0, 0.8, "roman_upper"),
    "1.1 Getting started": ("chapter", "numbered_simple", "1", "1 Getting started", 0, 0.65, "arabic"),
    "XII. Results": ("chapter", "roman_numbered", "XII", "Results", 0, 0.7, "roman_upper"),
    "B. Details of it": ("section", "letter_section", "B", "Details of it", 1, 0.7, "letter_upper"),
    "iv. small": ("section", "roman_section", "iv", "small", 1, 0.65, "roman_lower"),
    "Worked Example": ("heading", "title_case", None, "Worked Example", 1, 0.8, "none"),
    "EXERCISES": ("heading", "all_caps", None, "EXERCISES", 1, 0.6, "none"),
}


def test_lines(spark):
    rows = spark.createDataFrame([(k,) for k in [*LINES, "plain text here.", "x", ""]], "line string")
    found = S.with_fields(rows.withColumn("pattern", S.pattern_of(F.col("line"))).where("pattern IS NOT NULL")).collect()
    got = {r["line"]: tuple(r[f] for f in ("kind", "pattern", "number", "title", "level", "confidence", "style")) for r in found}
    assert got == LINES


def test_spans_and_hierarchy(spark):
    text = "intro\nChapter 1: One\nbody\nA. First\nmore\nChapter 2: Two\nB. Second\nend"
    books = spark.createDataFrame([(1, text), (2, ""), (3, "nothing here")], "book_id long, text string")
    found = structure.elements(books)
    starts = [text.index(x) for x in ("Chapter 1", "A. ", "Chapter 2", "B. ")]
    rows = structure.spans(found).orderBy("line_no").collect()
    assert [(r["start"], r["finish"], r["until"]) for r in rows] == [(starts[0], starts[1], starts[2]), (starts[1], starts[2], starts[2]), (starts[2], starts[3], len(text)), (starts[3], len(text), len(text))]
    h = {r["book_id"]: r for r in structure.hierarchy(books, found).collect()}
    assert (h[1]["chapters"], h[1]["sections"], h[1]["depth"], h[1]["is_valid"]) == (2, 2, 1, False)
    assert h[1]["warnings"] == "few_chapters" and h[2]["quality"] == 0 and not h[3]["is_valid"]


@pytest.mark.parametrize(
    ("title", "part", "kind", "want"),
    [
        ("Chapter 1", "Copyright 2020 by us", "chapter", "copyright"),
        ("References", "[1] someone", "heading", "bibliography"),
        ("Preface", "learning objectives of this book", "heading", "core"),
        ("Preface", "thanks to all", "heading", "prefatory"),
        ("Lists", "One ..... 1\nTwo ...... 2\nthree", "heading", "contents"),
        (None, "some words", None, "core"),
        (None, "  \n ", None, "unknown"),
    ],
)
def test_classes(spark, title, part, kind, want):
    rows = spark.createDataFrame([(1, 0, len(part), kind, title, part)], "book_id long, start long, finish long, kind string, title string, part string")
    assert filtering.classified(rows).first()["class"] == want


def test_signs_are_tried_only_where_their_words_are(spark):
    """As the patterns alone tell; a text has none of the words only if no pattern matches."""
    import random

    from pyspark.sql import functions as F

    from skeinlake.operators import filtering as G

    rng = random.Random(2)
    bits = ["Copyright ", "©", "(C) ", "1999", "2001 ", "\n", " \n", "TABLE  of\tContents", "contents", "Preface", "INTRODUCTION", "acknowledgmen", "t", "s", "Thanks", "About the Author", "author biography", "Published by", "İSBN", "isbn", "Appendix b", "appendices", "References", "work cited", "works\ncited", "Subject index", "Terms", "glossary", "Answer key", "solutions", "[3]", "et al.", " word "]
    texts = spark.createDataFrame([("".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))),) for _ in range(3000)] + [(None,)], "t string")
    t, low, signs = F.col("t"), F.lower("t"), G.PREFATORY | G.APPENDIX
    found = texts.select(*(F.count_if(t.rlike(p)).alias(n) for n, p in signs.items()), *(F.count_if(~G.has_sign(t, low, n).eqNullSafe(t.rlike(p))).alias(n + "_wrong") for n, p in signs.items())).first().asDict()
    assert all(found[n] > 0 and found[n + "_wrong"] == 0 for n in signs)
