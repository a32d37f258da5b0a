"""Full-text match and rank over a column of texts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prose import PRONOUNS, STOP_WORDS

#: Endings that are cut once, so that forms of a word meet; not a full stemmer.
ENDINGS = "(ing|ed|es|s)$"


def terms_of(query: str) -> list[str]:
    """The terms of a query in order of their first use, without stop words."""
    words = [w for w in re.findall("[a-z]+", query.lower()) if w not in STOP_WORDS and w not in PRONOUNS]
    return list(dict.fromkeys(re.sub(ENDINGS, "", w) for w in words))


def ranked(rows: DataFrame, id_col: str, text_col: str, query: str, k: int) -> DataFrame:
    """id and rank of the k best rows that hold all terms: the terms' uses over 1 + ln of the number of words."""
    wanted = terms_of(query)
    terms = F.transform(F.regexp_extract_all(F.lower(text_col), F.lit("[a-z]+"), F.lit(0)), lambda w: F.regexp_replace(w, ENDINGS, ""))
    rows = rows.select(id_col, terms.alias("terms"))
    counts = [F.size("terms") - F.size(F.array_remove("terms", w)) for w in wanted]
    rows = rows.select(id_col, F.size("terms").alias("n"), *(c.alias(f"c{i}") for i, c in enumerate(counts)))
    for i in range(len(wanted)):
        rows = rows.where(F.col(f"c{i}") > 0)
    uses = sum((F.col(f"c{i}") for i in range(len(wanted))), F.lit(0))
    return rows.select(id_col, F.round(uses / (1 + F.ln("n")), 6).alias("rank")).orderBy(F.desc("rank"), id_col).limit(k)
