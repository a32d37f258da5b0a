"""Concepts that a section's lines introduce, with the text up to the next one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BLANKS = r"[\x20\x09-\x0D]"
#: Words and forms that introduce a concept, in order; the first group is its name, of a numbered heading its number.
#: The number behind a word is one optional part, so that a run of blanks is read once.
FORMS = [
    rf"(?im)\b(?:Definition|Theorem|Lemma|Corollary|Proposition|Example|Algorithm|Concept){_BLANKS}*(?:\d+\.?\d*:?{_BLANKS}*|\.\d*:?{_BLANKS}*|:{_BLANKS}*)?([^\n]+)",
    rf"(?im)\b(?:Key Concept|Important Concept|Main Idea):{_BLANKS}*([^\n]+)",
    rf"(?im)^(\d+\.\d+\.\d+){_BLANKS}+[^\n]+$",
]
#: Characters of a name, and concepts of a section.
NAME_LENGTH, MOST = 100, 10


def introduced(sections: DataFrame, keys: list[str], text_col: str = "text", most: int = MOST) -> DataFrame:
    """keys, place, concept, begin, finish (in characters of the section): each section's first concepts, in order of their places.

    A name counts once in a section, where the first form that finds it does so first; names are told apart with their case.  A concept
    reaches to the next one, of those left out too, or to the end of the section.  `keys` tell sections apart (nulls are alike); null, empty
    and plain texts have no concepts, and other columns are not looked at.  The work of a section is one group: texts are held whole anyway.
    """
    texts = sections.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    groups = [f"_k{i}" for i in range(len(keys))]

    def of_form(form: int, pattern: str) -> DataFrame:
        # Line ends are line feeds alone, as the pattern's own flag for Java says.
        pattern = pattern.replace("(?im)", "(?imd)")
        parts = [F.split("_text", pattern, -1).alias("_ps"), *(F.regexp_extract_all("_text", F.lit(pattern), F.lit(g)).alias(n) for n, g in (("_ms", 0), ("_ns", 1)))]
        rows = texts.where(F.col("_text").rlike(pattern)).select(*groups, F.length("_text").alias("_size"), *parts)
        rows = rows.select(*groups, "_size", F.posexplode(F.arrays_zip("_ps", "_ms", "_ns")).alias("_i", "_z")).where("_z._ms IS NOT NULL")
        before = F.sum(F.length("_z._ps") + F.length("_z._ms")).over(Window.partitionBy(*groups).orderBy("_i"))
        name = F.regexp_replace(F.regexp_replace("_z._ns", f"^{_BLANKS}+|{_BLANKS}+$", ""), f"{_BLANKS}+", " ")
        return rows.select(*groups, "_size", F.lit(form).alias("_form"), (before - F.length("_z._ms")).alias("_at"), F.substring(name, 1, NAME_LENGTH).alias("concept"))

    every = reduce(DataFrame.unionByName, [of_form(k, p) for k, p in enumerate(FORMS)]).where("concept <> ''")
    firsts = every.groupBy(*groups, "concept").agg(F.min(F.struct("_form", "_at")).alias("_first"), F.max("_size").alias("_size"))
    w = Window.partitionBy(*groups).orderBy("_first._at", "concept")
    found = firsts.select(*groups, F.row_number().over(w).cast("long").alias("place"), "concept", F.col("_first._at").alias("begin"), F.coalesce(F.lead("_first._at").over(w), F.col("_size")).cast("long").alias("finish"))
    return found.where(F.col("place") <= most).select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), "place", "concept", "begin", "finish")
