"""Cleaning of extracted prose, measures of chunks, and parsing of generated answers, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .structure import clamped

#: Mathematical content that cleaning leaves alone.
MATH = r"\$[^$]+\$|\\[a-zA-Z]+\{[^}]*\}|[∫∑∏√≤≥≠±∓∞πα-ωΑ-Ω]|\b\d+\s*[+\-*/=±]\s*\d+\b|\b(?:sin|cos|tan|log|ln|exp|lim|int|sum|prod|sqrt)\s*\([^)]+\)"
#: Lines of page headers and footers.
ARTIFACTS = [r"^\s*page\s+\d+\s*(?:of\s+\d+)?\s*$", r"^\s*\d+\s*$", r"^\s*Chapter\s+\d+\s*$", r"^\s*\d+\.\d+\s*$", r"copyright\s+©?\s*\d{4}.*$", r"^\s*\.{3,}\s*\d+\s*$"]
IGNORE_CASE = (0, 4)
#: Places where a blank is missing.
MISSING_BLANKS = [
    ("([a-z])([A-Z])", "$1 $2"), ("([a-zA-Z])([0-9])", "$1 $2"), ("([0-9])([a-zA-Z])", "$1 $2"), ("([.!?])([A-Z])", "$1 $2"), (r"\.([a-z])", ". $1"), ("([,;:])([A-Za-z])", "$1 $2"),
    (r"([a-zA-Z])([+\-*/=])([a-zA-Z])", "$1 $2 $3"), ("([a-z])([A-Z][a-z])", "$1 $2"), (r"\b(Dr|Mr|Mrs|Ms|Prof|etc)\.([A-Z])", "$1. $2"),
]
#: Characters and what becomes of them.
REPLACED = ("“”‘’–—\u00a0", "\"\"''-- ")
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: Words that are no keywords, of structured and of other texts.
STOP_WORDS = "the a an and or but in on at to for of with by is are was were be been being have has had do does did will would should could can may might must this that these those".split()
PRONOUNS = "we you they it he she him her them us".split()
#: Symbols that make a text more difficult.
SYMBOLS = "≈≠≤≥±∞√∑∏∫∮∂∇πθφλμσρΔΩαβγ"
#: Terms of teaching texts.
TEACHING = "definition theorem proof example exercise problem solution chapter section figure table equation formula concept principle theory method approach".split()
#: What tells the kind of a chunk; the first that is there decides.
MATH_MARKS = ["equation", "formula", "$", "∫", "∑", "∏", "∂", "∇", "≈", "≠", "≤", "≥"]
DEFINITION_MARKS = ["definition:", "define", "is defined as", "we define", "by definition"]
EXAMPLE_MARKS = ["example", "for instance", "consider", "suppose", "exercise", "problem"]


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def artifact_pattern(k: int) -> str:
    """A line pattern for Java, where only line feeds end lines."""
    return ("(?mdi)" if k in IGNORE_CASE else "(?md)") + ARTIFACTS[k]


def without_artifacts(text: Column) -> Column:
    for k in range(len(ARTIFACTS)):
        text = F.regexp_replace(text, artifact_pattern(k), "")
    return text


def artifact_count(text: Column) -> Column:
    """Header and footer lines: each pattern counts what earlier ones have left."""
    total = F.lit(0)
    for k in range(len(ARTIFACTS)):
        total = total + F.regexp_count(text, F.lit(artifact_pattern(k)))
        text = F.regexp_replace(text, artifact_pattern(k), "")
    return total


def with_blanks(text: Column) -> Column:
    """Blanks where they are missing, but not inside mathematical content."""

    def repaired(part: Column) -> Column:
        for pattern, by in MISSING_BLANKS:
            part = F.regexp_replace(part, pattern, by)
        return part

    parts = F.transform(F.split(text, MATH), repaired)
    kept = F.concat(F.regexp_extract_all(text, F.lit(MATH), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, kept, lambda a, b: F.concat(a, b)), "")


def normal_blanks(text: Column) -> Column:
    """One blank between words, one empty line between paragraphs."""
    text = F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), " ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), "^[ \n]+|[ \n]+$", "")


def rejoined(text: Column) -> Column:
    """Lines that break a sentence joined to the next one; twice, as matches cannot overlap."""
    for _ in range(2):
        text = F.regexp_replace(text, "([^.!?\n])\n([a-z])", "$1 $2")
    return text


def paragraphs(text: Column) -> Column:
    """Each paragraph on one line."""
    return F.array_join(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, "\n", " ")), "\n\n")


def cleaned(text: Column) -> Column:
    t = F.regexp_replace(F.translate(text, *REPLACED), "…", "...")
    return paragraphs(rejoined(normal_blanks(with_blanks(without_artifacts(t)))))


def cleaning_quality(text: Column, clean: Column, issues: Column) -> Column:
    """1, less for lost text, more for repairs, a usual share of sentence ends and paragraphs; between 0 and 1."""
    ratio = F.try_divide(F.length(clean), F.length(text))
    words, ends = F.regexp_count(clean, F.lit(WORD)), F.regexp_count(clean, F.lit("[.!?]+"))
    score = 1.0 - F.when(ratio < 0.5, 0.3).when(ratio < 0.8, 0.1).otherwise(0.0) + F.least(F.lit(0.2), issues * 0.01)
    score = score + F.when((ends * 100 / words).between(5, 20), 0.1).otherwise(0.0) + F.when(clean.contains("\n\n"), 0.05).otherwise(0.0)
    return F.when(clean == "", 0.0).otherwise(clamped(score))


def chunk_clean(text: Column, least_rule: int) -> Column:
    """Before chunking: fewer blank lines and blanks, no page lines, no rules of `least_rule` dashes or more."""
    text = F.regexp_replace(F.regexp_replace(text, "\n[ \t\n]*\n[ \t]*\n+", "\n\n"), " +", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?md)^Page \d+[^\n]*\n", ""), r"(?md)\n[^\n]*Page \d+[^\n]*$", "")
    return F.regexp_replace(F.regexp_replace(text, f"(?md)^[-_]{{{least_rule},}}[^\n]*$", ""), r"^[ \n\t]+|[ \n\t]+$", "")


def embedding_input(text: Column, most_tokens: int, instructions: str = "") -> Column:
    words = word_array(text)
    most = int(most_tokens * 0.75)
    out = F.when(F.size(words) > most_tokens * 0.75, F.concat(F.array_join(F.slice(words, 1, most), " "), F.lit("..."))).otherwise(F.array_join(words, " "))
    return F.concat(F.lit(instructions + "\n\n"), out) if instructions else out


def kind_of_chunk(text: Column) -> Column:
    any_of = lambda t, marks: F.coalesce(*[F.when(t.contains(m), F.lit(True)) for m in marks], F.lit(False))
    low = F.lower(text)
    return F.when(any_of(text, MATH_MARKS), "math").when(any_of(low, DEFINITION_MARKS), "definition").when(any_of(low, EXAMPLE_MARKS), "example").otherwise("text")


def mean_word_length(text: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")), F.regexp_count(text, F.lit(WORD))), F.lit(0.0))


def mean_sentence_words(text: Column) -> Column:
    parts = F.split(text, "[.!?]+", -1)
    return F.aggregate(parts, F.lit(0), lambda a, s: a + F.regexp_count(s, F.lit(WORD))) / F.size(parts)


def difficulty(text: Column, kind: Column, structured: bool = True) -> Column:
    """From the kind, long words, long sentences and, in structured texts, the number of different symbols."""
    base, math, definition = (0.5, 0.2, 0.15) if structured else (0.4, 0.3, 0.2)
    score = F.lit(base) + F.when(kind == "math", math).when(kind == "definition", definition).when(kind == "example", -0.1).otherwise(0.0)
    score = score + F.when(mean_word_length(text) > 6, 0.1).otherwise(0.0) + F.when(mean_sentence_words(text) > 20, 0.1).otherwise(0.0)
    if structured:
        score = score + F.length(F.regexp_replace(F.array_join(F.array_distinct(F.split(text, "")), ""), f"[^{SYMBOLS}]", "")) * 0.02
    return clamped(score)


def confidence(text: Column, kind: Column, structured: bool = True, least: int = 300, most: int = 1500) -> Column:
    n, ends = F.length(text), F.regexp_count(text, F.lit("[.!?]+"))
    whole = F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1).isin(".", "!", "?")
    size = F.when(n.between(least, most), 0.1).when(n < least, -0.2).otherwise(0.0)
    if structured:
        return clamped(0.8 + size + F.when(kind.isin("math", "definition", "example"), 0.1).otherwise(0.0) - F.when((ends > 0) & ~whole, 0.1).otherwise(0.0))
    words = F.regexp_count(text, F.lit(WORD))
    ending = F.when(ends == 0, 0.0).when(whole, 0.1).otherwise(-0.1)
    return clamped(0.6 + size + ending + F.when(F.try_divide(words, ends).between(5, 25), 0.05).otherwise(0.0))


def unique_share(text: Column) -> Column:
    w = word_array(F.lower(text))
    return F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_distinct(w)) / F.size(w))


def is_valid_chunk(text: Column, sure: Column) -> Column:
    # Words are found once: a lambda binds them.
    told = lambda w: (F.size(w) >= 5) & ((F.size(w) <= 10) | (F.size(F.array_distinct(w)) / F.size(w) >= 0.3))
    words_fit = F.transform(F.array(word_array(F.lower(text))), told)[0]
    return (F.length(F.trim(text, F.lit(BLANKS))) >= 50) & (sure >= 0.2) & words_fit


def overlap_score(answer: Column, expected: Column) -> Column:
    """Share of the expected words in the answer, 0.9 at most, less for short answers; half of it without expected words."""
    a, b = (F.array_distinct(word_array(F.lower(x))) for x in (answer, expected))
    score = F.when(F.size(b) == 0, 0.5).otherwise(F.least(F.lit(0.9), F.size(F.array_intersect(a, b)) / F.size(b)))
    return F.round(score * F.when(F.length(answer) < 50, 0.8).otherwise(1.0), 2)


def generated(text: Column) -> Column:
    """Generated text without labels, numbering, bullets and a last fragment."""
    t = F.regexp_replace(text, r"(?i)^(question|expected_answer):\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"^\d+\.\s*", ""), r"^[-*]\s*", "")
    t = F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " "))
    parts = F.split(t, "[.!?]+", -1)
    cut = F.concat(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), "."), F.lit("."))
    return F.when((t == "") | t.rlike("[.!?;:]$") | (F.size(parts) < 2), t).otherwise(cut)


def labelled(text: Column, label: str, next_label: str | None = None) -> Column:
    """What stands between a label and the next one, or the end; null if the label is not there."""
    stop = f"(?:{next_label}|$)" if next_label else "$"
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?is){label}:\s*(.+?)\s*{stop}", 1), r"[\x20\x09-\x0D]+", " ")), F.lit(""))
