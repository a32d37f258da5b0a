"""Chunks of texts: greedy packing of paragraphs, boundaries by sentences, and boundaries that keep formulas, definitions and examples whole.

Boundaries are chosen one after the other, each from where the last one fell; this small fold runs in tasks, a text at a
time, and its time is linear in the text.  Everything around it (structure, sections, measures, choice of the way) is column work.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prose as P
from ..functions.batches import slices
from . import structure
from .lineage import cut

#: Words whose stop ends no sentence.
ABBREVIATIONS = frozenset("dr mr mrs ms prof vs etc ie eg cf fig eq eqn sec ch vol no pp p st nd rd th inc corp ltd co ibid circa ca approx cm mm km kg mg ml hr min max avg std var def thm prop cor".split())
#: Target, least and most characters of a chunk and overlap, by sentences and by structure.
BY_SENTENCES = (1000, 300, 1500, 200)
BY_STRUCTURE = (1250, 300, 1500, 150)
#: Formulas that one pattern tells.  What has a begin and an end is found by `_opened`, in linear time however far apart they are.
_IN_SENTENCES = [
    re.compile(r"\$[^$]+\$"),
    re.compile(r"[∑∏∫∮∂∇][^.!?]*"),
]
_IN_STRUCTURE = [
    re.compile(r"\$[^$]+\$", re.I),
    re.compile(r"[∑∏∫∮∂∇][\w\s()]+", re.I),
    re.compile(r"[α-ωΑ-Ω][\w\s]*", re.I),
    re.compile(r"[xy][\d²³⁴]+\s*[+\-]\s*[xy]?[\d²³⁴]*", re.I),
]
_NOT_ASCII = _IN_STRUCTURE[1:3]
#: How commands, environments, fractions, equations of numbers and of functions begin.
_COMMAND = re.compile(r"\\[a-zA-Z]+\{")
_ENVIRONMENT = re.compile(r"\\begin\{(equation|align|eqnarray)\}", re.I)
_FRACTION = re.compile(r"\\frac\{", re.I)
_NUMBERS = re.compile(r"\b\d+\s*[+\-*/=]\s*\d+")
_FUNCTION = re.compile(r"[fx]\(", re.I)
_VALUE, _DIGITS = re.compile(r"\s*=\s*[^,.\n]+"), re.compile(r"\d+")


class _Marks:
    """Finds marks in a text from rising places; each stretch of the text is read once for a mark."""

    def __init__(self, text: str) -> None:
        self.text, self.known = text, {}

    def find(self, mark: str | re.Pattern, at: int) -> int:
        """The end of the next such mark, or -1."""
        begin, place, end = self.known.get(mark, (1, 0, 0))
        if not begin <= at <= place:
            if isinstance(mark, str):
                place = self.text.find(mark, at)
                end = place + len(mark)
            else:
                m = mark.search(self.text, at)
                place, end = m.span() if m else (-1, -1)
            place, end = (place, end) if place >= 0 else (len(self.text) + 1, -1)
            self.known[mark] = (at, place, end)
        return end


def _opened(text: str, opener: re.Pattern, close: Callable[[re.Match], int]) -> Iterator[tuple[int, int]]:
    """Spans from an opener to where `close` says that they end; it says -1 if they do not."""
    at = 0
    while m := opener.search(text, at):
        end = close(m)
        if end >= 0:
            yield m.start(), end
        at = end if end >= 0 else m.start() + 1


def _commands(text: str, marks: _Marks) -> Iterator[tuple[int, int]]:
    return _opened(text, _COMMAND, lambda m: marks.find("}", m.end()))


def _environments(text: str, marks: _Marks) -> Iterator[tuple[int, int]]:
    return _opened(text, _ENVIRONMENT, lambda m: marks.find("\\end{" + m.group(1) + "}", m.end()))


def _fractions(text: str, marks: _Marks) -> Iterator[tuple[int, int]]:
    def close(m: re.Match) -> int:
        first = marks.find("}", m.end())
        if first < m.end() + 2 or text[first : first + 1] != "{":
            return -1
        second = text.find("}", first + 1) + 1
        return second if second >= first + 3 else -1

    return _opened(text, _FRACTION, close)


def _number_equations(text: str, marks: _Marks) -> Iterator[tuple[int, int]]:
    def close(m: re.Match) -> int:
        sign = marks.find("=", m.end())
        return sign if sign < 0 else marks.find(_DIGITS, sign)

    return _opened(text, _NUMBERS, close)


def _function_equations(text: str, marks: _Marks) -> Iterator[tuple[int, int]]:
    def close(m: re.Match) -> int:
        end = marks.find(")", m.end())
        value = _VALUE.match(text, end) if end >= m.end() + 2 else None
        return value.end() if value else -1

    return _opened(text, _FUNCTION, close)


def formulas_in_sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for p in _IN_SENTENCES for m in p.finditer(text)] + list(_commands(text, _Marks(text)))


def formulas_in_structure(text: str) -> list[tuple[int, int]]:
    marks = _Marks(text)
    patterns = _IN_STRUCTURE if not text.isascii() else [p for p in _IN_STRUCTURE if p not in _NOT_ASCII]
    finders = [_environments, _fractions] if "\\" in text else []
    finders += [_number_equations, _function_equations] if "=" in text else []
    return [m.span() for p in patterns for m in p.finditer(text)] + [s for find in finders for s in find(text, marks)]


#: How definitions, examples and solutions begin; a subject of more than a hundred characters is none.
_DEFINES = re.compile(r"(?:Definition|Define)[:.]?\s*[^.!?]|\b[A-Z][a-z]{1,40}\s+is\s+(?:defined as|a|an)\s|\b(?:Let|Suppose)\s[^.!?]{1,100}\s(?:be|denote|represent)\s|(?:We define|By definition)\s", re.I)
_EXAMPLE = re.compile(r"(?:Example|Ex\.?|Exercise|Problem)\s*\d*[:.]?\s*[^.!?]|(?:Consider|Suppose)\s+the\s+(?:following|case|example)|For\s+(?:instance|example)[,:]?", re.I)
_SOLUTION = re.compile(r"(?:Solution|Answer|Proof)[:.]?|(?:We\s+(?:have|get|obtain|find)|Therefore|Thus|Hence)[,:]?", re.I)
_SENTENCE, _PARAGRAPH = re.compile(r"[.!?]+\s+"), re.compile(r"\n\s*\n")
#: What each match of these patterns begins with, and what is in each definition, in small letters.
_EXAMPLE_BEGINS = ("ex", "problem", "consider", "suppose", "for")
_SOLUTION_BEGINS = ("solution", "answer", "proof", "we", "therefore", "thus", "hence")
_IN_DEFINITION, _IS = ("defin", "let", "suppose"), re.compile(r"\sis\s")
#: Letters that patterns take for i, s and k, but small letters do not.
_ALIKE = "\u0130\u0131\u017f\u212a"


def _small(text: str) -> str | None:
    """The text in small letters, place for place; null if it has letters that only patterns take for others."""
    return None if not text.isascii() and any(c in text for c in _ALIKE) else text.lower()


def _places(text: str, marks: tuple[str, ...]) -> list[int]:
    out = []
    for mark in marks:
        at = text.find(mark)
        while at >= 0:
            out.append(at)
            at = text.find(mark, at + 1)
    return sorted(out)


def _begins(pattern: re.Pattern, text: str, low: str | None, marks: tuple[str, ...]) -> list[int]:
    """Where the matches of a pattern begin, tried only where one of these marks is."""
    if low is None:
        return [m.start() for m in pattern.finditer(text)]
    out, end = [], 0
    for at in _places(low, marks):
        if at >= end and (m := pattern.match(text, at)):
            out.append(at)
            end = m.end()
    return out


#: What a protected region holds, as bits: a region of several kinds has several, one of a function's value alone has none.
MATH, DEFINITION, EXAMPLE = 1, 2, 4
KINDS = {MATH: "math", DEFINITION: "definition", EXAMPLE: "example"}


def united(regions: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(begin, end, kinds): regions with at most `gap` characters between them as one, which is of all their kinds."""
    out: list[tuple[int, int, int]] = []
    for a, b, kinds in sorted(regions):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b), out[-1][2] | kinds)
        else:
            out.append((a, b, kinds))
    return out


def merged(regions: list[tuple[int, int]], gap: int) -> list[tuple[int, int]]:
    """Regions with at most `gap` characters between them as one."""
    return [(a, b) for a, b, _ in united([(a, b, 0) for a, b in regions], gap)]


def _region_at(regions: list[tuple[int, int]], pos: int) -> tuple[int, int] | None:
    k = bisect_right(regions, (pos, float("inf"))) - 1
    return regions[k] if k >= 0 and regions[k][0] <= pos <= regions[k][1] else None


def sentence_ends(text: str) -> list[tuple[int, float]]:
    """Where sentences end, after the white space behind them, and how sure that is."""
    formulas = merged(formulas_in_sentences(text), 0)
    out = []
    for m in re.finditer(r"[.!?]+\s*", text):
        pos = m.end()
        before = re.search(r"([A-Za-z.-]*[A-Za-z])[^A-Za-z]*$", text[max(0, m.start() - 12) : pos])
        near = text[max(0, pos - 10) : pos]
        if _region_at(formulas, pos) or (before and before.group(1).lower() in ABBREVIATIONS) or text[pos : pos + 1].islower():
            continue
        if any(x in near.lower() for x in ("et al", "i.e", "e.g")) or re.search(r"\d+\.\s*$", near):
            continue
        sure = 0.8 * (1.2 if text[pos : pos + 5].strip()[:1].isupper() else 1.0) * (1.3 if "\n" in text[pos : pos + 3] else 1.0)
        out.append((pos, min(1.0, sure)))
    return out


def paragraph_ends(text: str) -> list[int]:
    return sorted({m.end() for m in _PARAGRAPH.finditer(text)} | {m.start() + 1 for m in re.finditer(r"\n\s{4,}[A-Z]", text)})


def _blank_near(text: str, at: int) -> int:
    for i in range(at, min(len(text), at + 50)):
        if text[i].isspace():
            return i
    for i in range(at - 1, max(0, at - 50) - 1, -1):
        if text[i].isspace():
            return i + 1
    return at


def _blank_before(text: str, at: int) -> int:
    if text[at].isspace():
        return at
    return next((i + 1 for i in range(at, max(0, at - 100), -1) if text[i].isspace()), at)


def by_sentences(text: str, sizes: tuple[int, int, int, int] = BY_SENTENCES) -> list[tuple[int, int, str]]:
    """(begin, end, chunk): ends at the best of the paragraph and sentence ends near the target, else between words.

    What begins are is without the overlap: they and the ends cover the text.  A chunk that is too small joins the one
    before it; a text that is smaller than a chunk is one.
    """
    target, least, most, overlap = sizes
    ends = sorted([(p, 0.8 * sure) for p, sure in sentence_ends(text)] + [(p, 1.0) for p in paragraph_ends(text)], key=lambda e: e[0])
    places = [p for p, _ in ends]
    out: list[tuple[int, int, str]] = []
    pos = 0
    while pos < len(text):
        goal, end = pos + target, len(text)
        if goal < len(text):
            near = ends[bisect_left(places, pos + least) : bisect_right(places, min(len(text), pos + most))]
            best = max(near, key=lambda e: e[1] * (1 - min(0.5, abs(e[0] - goal) / (target * 0.5))), default=None)
            end = max(best[0] if best else _blank_near(text, goal), pos + 1)
        begin = _blank_before(text, max(0, pos - overlap)) if out and pos else pos
        chunk = text[begin:end].strip()
        if out and len(chunk) < least:
            out[-1] = (out[-1][0], end, f"{out[-1][2]} {chunk}".strip())
        elif chunk:
            out.append((pos, end, chunk))
        pos = end
    return out


def _formula_kind(formula: str) -> int:
    """Formulas are mathematics, but for values of functions such as "f(x) = y", without dollars and signs of operations."""
    marked = formula.startswith("$") or "\\begin{" in formula or ("=" in formula and any(x in formula for x in "+-*/"))
    return MATH if marked or not ("f(" in formula or "g(" in formula) else 0


def formula_regions(text: str) -> list[tuple[int, int, int]]:
    return [(a, b, _formula_kind(text[a:b])) for a, b in formulas_in_structure(text)]


def definition_regions(text: str) -> list[tuple[int, int, int]]:
    """Sentences that define something, with the one behind them, and one more if that is short."""
    ends = [m.span() for m in _SENTENCE.finditer(text)]
    out, begin, stops, low = [], 0, [e for _, e in ends], _small(text)
    signs = None if low is None else sorted([*_places(low, _IN_DEFINITION), *(m.start() for m in _IS.finditer(low))])
    for a, b in [*ends, (len(text), len(text))]:
        if (signs is None or bisect_left(signs, begin) < bisect_left(signs, a)) and _DEFINES.search(text, begin, a):
            k = bisect_right(stops, a)
            short = k + 1 < len(stops) and stops[k] - a < 100
            out.append((begin, stops[k + short] if k < len(stops) else min(a + 200, len(text)), DEFINITION))
        begin = b
    return out


def example_regions(text: str) -> list[tuple[int, int, int]]:
    """Examples with a solution near them, or up to the end of their paragraph."""
    low, breaks = _small(text), [m.start() for m in _PARAGRAPH.finditer(text)]
    examples = _begins(_EXAMPLE, text, low, _EXAMPLE_BEGINS)
    solutions = _begins(_SOLUTION, text, low, _SOLUTION_BEGINS) if examples else []
    after = lambda places, pos: places[k] if (k := bisect_left(places, pos)) < len(places) else None
    out = []
    for a in examples:
        answer = after(solutions, a)
        if answer is not None and answer - a < 500:
            end = after(examples, answer + 51) or after(breaks, answer + 51) or answer + 300
        else:
            end = after(breaks, a) or a + 200
        out.append((a, min(end, len(text)), EXAMPLE))
    return out


def protected_kinds(text: str) -> list[tuple[int, int, int]]:
    """(begin, end, kinds) of formulas, definitions and examples; close ones are one region."""
    return united(united(formula_regions(text), 10) + definition_regions(text) + united(example_regions(text), 0), 20)


def protected(text: str) -> list[tuple[int, int]]:
    return [(a, b) for a, b, _ in protected_kinds(text)]


def kind_in(regions: list[tuple[int, int, int]], begin: int, end: int) -> str:
    """The kind of the first region that reaches into these characters and has one; of several, mathematics, then definition, then example."""
    for a, b, kinds in regions:
        if a < end and b > begin and kinds:
            return KINDS[kinds & -kinds]
    return "text"


def by_structure(text: str, sizes: tuple[int, int, int, int] = BY_STRUCTURE, regions: list[tuple[int, int]] | None = None) -> list[tuple[int, int, str]]:
    """(begin, end, chunk) of a section: ends behind or before a protected region at the target, else at the best of paragraph, sentence and word ends around it."""
    target, least, _, overlap = sizes
    if len(text.strip()) < least:
        return [(0, len(text), text)] if text.strip() else []
    regions = protected(text) if regions is None else regions
    ends, pos = [], 0
    while pos + target < len(text):
        goal = pos + target
        low, high = max(pos + least, goal - 200), min(len(text), goal + 200)
        region = _region_at(regions, goal)
        if region and region[1] < high and region[1] > pos:
            pos = region[1]
        elif region and region[0] > low:
            pos = region[0]
        else:
            found = [(low + m.end(), q) for p, q in ((_PARAGRAPH, 0.9), (re.compile(r"[.!?]\s+"), 0.7), (re.compile(r"\s+"), 0.5)) for m in p.finditer(text[low:high])]
            pos = max(found, key=lambda c: 0.7 * c[1] + 0.3 * max(0, 1 - abs(c[0] - goal) / 200))[0] if found else goal
        ends.append(pos)
    out: list[tuple[int, int, str]] = []
    pos = 0
    for end in [*ends, len(text)]:
        chunk = text[max(0, pos - overlap) if out else pos : end].strip()
        if out and len(chunk) < least:
            out[-1] = (out[-1][0], end, f"{out[-1][2]} {text[pos:end].strip()}".strip())
        elif chunk:
            out.append((pos, end, chunk))
        pos = end
    return out


def by_structure_with_kinds(text: str, sizes: tuple[int, int, int, int] = BY_STRUCTURE) -> list[tuple[int, int, str, str, str, int]]:
    """Chunks of a section as `by_structure` cuts them, with the kind that protected regions give them.

    `kind` looks at regions that reach into begin..finish, `kind_from_start` at those that begin before the chunk's length, as if each chunk
    were its section's first; `regions` counts the former.  A section that is too small to be cut is text.
    """
    if len(text.strip()) < sizes[1]:
        return [(*c, "text", "text", 0) for c in by_structure(text, sizes)]
    regions = protected_kinds(text)
    cuts = by_structure(text, sizes, [(a, b) for a, b, _ in regions])
    return [(a, b, c, kind_in(regions, a, b), kind_in(regions, 0, len(c)), sum(x < b and y > a for x, y, _ in regions)) for a, b, c in cuts]


#: The columns that `by_structure_with_kinds` adds.
KIND_COLUMNS = {"kind": "string", "kind_from_start": "string", "regions": "long"}


def greedy(text: str, size: int = 1500) -> list[tuple[int, int, str]]:
    """Paragraphs in a row as long as they fit; (number of the first, of the one after the last, chunk)."""
    if len(text.strip()) <= size:
        return [(0, 1, text.strip())] if text.strip() else []
    out: list[list] = []
    for k, part in enumerate(p for p in map(str.strip, text.split("\n\n")) if p):
        if out and out[-1][2] + len(part) + 2 <= size:
            out[-1][1:3] = k + 1, out[-1][2] + len(part) + 2
            out[-1][3].append(part)
        else:
            out.append([k, k + 1, len(part), [part]])
    return [(a, b, "\n\n".join(parts)) for a, b, _, parts in out]


def chunks(rows: DataFrame, keys: list[str], text_col: str, cutter: Callable[[str], list[tuple]], more: dict[str, str] | None = None, spans_col: str | None = None) -> DataFrame:
    """keys, chunk_no, begin, finish, chunk of each text, and what else the cutter gives (name: type); null and blank texts have none.

    With spans (an array of begin and end in each row), each span of the text is cut by itself, and `section`, behind the keys, is where it begins; a
    row without spans is one section.
    """
    kinds = dict(rows.dtypes)
    given = ({"section": "long"} if spans_col else {}) | {"chunk_no": "long", "begin": "long", "finish": "long", "chunk": "string"} | (more or {})
    arrow = {"long": pa.int64(), "string": pa.string()}

    def found_in(text: str, spans: list[dict] | None) -> list[tuple]:
        if not spans_col:
            return [(k, *c) for k, c in enumerate(cutter(text))]
        ends = [tuple(s.values()) for s in spans or []] or [(0, len(text))]
        return [(a, k, *c) for a, b in ends for k, c in enumerate(cutter(text[a:b]))]

    def cut_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, found = [], []
        texts = batch.column(len(keys)).to_pylist()
        spans = batch.column(len(keys) + 1).to_pylist() if spans_col else [None] * len(texts)
        for i, text in enumerate(texts):
            some = found_in(text or "", spans[i])
            owner += [i] * len(some)
            found += some
        values = zip(*found, strict=True) if found else [()] * len(given)
        columns = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(keys))]
        columns += [pa.array(v, arrow[kind]) for v, kind in zip(values, given.values(), strict=True)]
        return pa.RecordBatch.from_arrays(columns, [*keys, *given])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(len(keys))).fill_null(0).to_pylist()
            yield from (cut_up(batch.slice(a, b - a)) for a, b in slices(sizes))

    columns = [*keys, text_col, *([spans_col] if spans_col else [])]
    return rows.select(*columns).mapInArrow(task, ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{k} {kind}" for k, kind in given.items()]))


def chunks_of_sections(books: DataFrame, cutter: Callable[[str], list[tuple]], more: dict[str, str] | None = None) -> DataFrame:
    """Chunks of the sections of books, as `sections` has them, which are cut out in the tasks that cut them: a book's text moves once, not with each of its sections."""
    found = structure.spans(structure.elements(books)).groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("start", "until"))).alias("spans"))
    return chunks(books.join(found, "book_id", "left"), ["book_id"], "text", cutter, more, "spans")


def sections(books: DataFrame) -> DataFrame:
    """book_id, section, title, text of every element to the next one of its level or above; a book without any is one section."""
    spans = structure.spans(structure.elements(books)).select("book_id", "start", "until", "title")
    rows = books.join(spans, "book_id", "left")
    begin = F.coalesce("start", F.lit(0))
    return rows.select("book_id", begin.alias("section"), F.coalesce("title", F.lit("Content")).alias("title"), F.when(F.col("start").isNull(), F.col("text")).otherwise(F.expr("substring(text, start + 1, until - start)")).alias("text"))


def chunked(books: DataFrame) -> DataFrame:
    """Chunks of books (book_id, text) in the way that each book's structure asks for: book_id, way, chunk_no, chunk, kind, sure.

    By structure, or by sentences where there is hardly any; where it is in doubt, by structure if its chunks are
    sure enough.  Chunks that are too short or repeat themselves are left out before they are numbered.
    """
    books = cut(books.where(F.col("text").isNotNull()))  # read more than once
    ways = structure.assessment(books, structure.elements(books)).select("book_id", "strategy")
    ways = cut(books.select("book_id").join(ways, "book_id", "left").select("book_id", F.coalesce("strategy", F.lit("fallback")).alias("strategy")))
    cleaned = books.select("book_id", P.chunk_clean(F.col("text"), 5).alias("text")).join(ways, "book_id")
    kind = P.kind_of_chunk(F.col("chunk"))

    def measured(rows: DataFrame, way: str) -> DataFrame:
        rows = rows.select("book_id", "section", "chunk_no", "chunk", kind.alias("kind"), F.lit(way).alias("way"))
        rows = rows.withColumn("sure", P.confidence(F.col("chunk"), F.col("kind"), way == "content_aware"))
        return rows.withColumn("valid", P.is_valid_chunk(F.col("chunk"), F.col("sure")))  # told before the cut: once for each chunk

    some = cleaned.where("strategy <> 'fallback'").select("book_id", "text")
    structured = measured(chunks_of_sections(some, by_structure), "content_aware")
    plain = chunks(cleaned.where("strategy <> 'content_aware'").select("book_id", F.lit(0).alias("section"), "text"), ["book_id", "section"], "text", by_sentences)
    both = cut(structured.unionByName(measured(plain.withColumn("section", F.col("section").cast(structured.schema["section"].dataType)), "fallback")))
    mean = both.where("way = 'content_aware'").groupBy("book_id").agg(F.avg("sure").alias("mean"))
    chosen = both.join(ways, "book_id").join(mean, "book_id", "left").where(F.when(F.col("strategy") != "hybrid", F.lit(True)).when(F.coalesce("mean", F.lit(0.0)) > 0.6, F.col("way") == "content_aware").otherwise(F.col("way") == "fallback"))
    valid = chosen.where("valid")
    number = F.row_number().over(Window.partitionBy("book_id").orderBy("section", "chunk_no")) - 1
    return valid.select("book_id", "way", number.cast("long").alias("chunk_no"), "chunk", "kind", "sure")
