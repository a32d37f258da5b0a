"""Measures, rules and cleaning of text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that keyword counts over whole languages leave out: our own choice of short English ones.
STOP_WORDS = ["the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "day", "get", "has", "him", "his", "how", "its", "may", "new", "now", "old", "see", "two", "who", "did", "this", "that", "with", "from", "they", "have", "been", "were", "said", "each"]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[.!?]+"))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), (word_count(text) * 1.3).cast("int"))


def keywords(text: Column) -> Column:
    """Runs of three or more ASCII letters in lower case, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def content_type(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("equation|formula|theorem|[=<>]"), "math").when(t.rlike("definition|is defined as"), "definition").when(t.rlike("example|for instance"), "example").otherwise("text")


def clean(text: Column) -> Column:
    """Repairs that keep line feeds: quotes and dashes, page lines, blanks inside lines, runs of blank lines."""
    t = F.translate(text, "‘’“”–— ", "''\"\"-- ")
    t = F.regexp_replace(t, r"(?m)^[ \t]*(Page[ \t]+)?\d+[ \t]*$", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"([a-z])([.!?])([A-Z])", "$1$2 $3")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_tags(html: Column) -> Column:
    t = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " "))
