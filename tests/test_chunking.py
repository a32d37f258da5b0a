"""Chunks cover their texts, keep to their sizes, and worked examples come out as described."""

from __future__ import annotations

import random
import time

import pytest

from skeinlake.operators import chunking


def text_of(seed, n=300):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta,", "e.g.", "Dr.", "$x + y$", "Example", "Solution:", "Definition:", "Let", "be", "1.", "x(2) = 3"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", "! ", "\n", "\n\n", ".\n"]) for _ in range(n))


@pytest.mark.parametrize("cutter", [chunking.by_sentences, chunking.by_structure])
@pytest.mark.parametrize("seed", range(12))
def test_no_character_is_lost(cutter, seed):
    text = text_of(seed, 50 + 150 * seed).strip()
    found = cutter(text)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(found[:-1], found[1:]))
    kept = set(" ".join(c for _, _, c in found).split())
    assert set(text.split()) <= kept
    assert all(len(c) >= 300 for _, _, c in found) or len(found) == 1


def test_sentence_ends():
    text = "See Dr. Who. It was e.g. fine. There is item 3. Next one! then lower. $a. B$ End."
    # Not after an abbreviation, a number of a list, before a small letter, or in a formula.
    assert [text[:p].split()[-1] for p, _ in chunking.sentence_ends(text)] == ["Who.", "fine.", "End."]


def test_protected_regions_are_not_cut():
    formula = "$" + "x + y " * 30 + "$"
    text = "word " * 230 + formula + " word" * 300
    ends = [e for _, e, _ in chunking.by_structure(text)][:-1]
    begin = text.index("$")
    assert ends and not any(begin < e < begin + len(formula) for e in ends)


def test_greedy():
    parts = ["a" * 700, "b" * 700, "c" * 200, "d" * 1600]
    assert [(a, b, len(c)) for a, b, c in chunking.greedy("\n\n".join(parts))] == [(0, 2, 1402), (2, 3, 200), (3, 4, 1600)]
    assert chunking.greedy(" \n ") == [] and chunking.greedy("short") == [(0, 1, "short")]


@pytest.mark.parametrize("text", ["a.b." * 100_000, "1+1 " * 100_000, "\\a{" * 100_000, "Example " * 50_000, "x" * 500_000, "Let a " * 50_000])
def test_long_texts_take_seconds(text):
    begin = time.perf_counter()
    chunking.by_sentences(text)
    chunking.by_structure(text)
    assert time.perf_counter() - begin < 20


def test_formulas_of_any_length_are_protected():
    """Against patterns without a bound, which take quadratic time on texts that the finders read once."""
    import random
    import re
    import time

    plain = [r"\\begin\{(equation|align|eqnarray)\}.*?\\end\{\1\}", r"\b\d+\s*[+\-*/=]\s*\d+.*?=.*?\d+", r"[fx]\([^)]+\)\s*=\s*[^,.\n]+", r"\\frac\{[^}]+\}\{[^}]+\}"]
    rng = random.Random(4)
    parts = ["\\begin{align}", "\\end{align}", "\\frac{", "}", "{", "a", "1+2", " = ", "7", "f(", ")", "x(t)", ".", "\n", " words " * 60]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 25)))
        want = sorted(m.span() for p in plain for m in re.finditer(p, text, re.S | (0 if "d+" in p else re.I)))
        marks = chunking._Marks(text)
        found = [s for find in (chunking._environments, chunking._fractions, chunking._number_equations, chunking._function_equations) for s in find(text, marks)]
        assert sorted(found) == want
        assert list(chunking._commands(text, chunking._Marks(text))) == [m.span() for m in re.finditer(r"\\[a-zA-Z]+\{[^}]*\}", text)]
    long = "Text. " * 200 + "\\begin{equation}" + "a + b " * 200 + "\\end{equation} After. " + "More. " * 200
    begin, end = long.index("\\begin"), long.index("After")
    assert any(a <= begin and end - 1 <= b for a, b in chunking.protected(long))
    clock = time.perf_counter()
    for text in ("\\frac{" * 100_000, "\\begin{align}" * 50_000, "1+2 " * 100_000, "f(" * 200_000, "\\a{" * 200_000):
        chunking.formulas_in_structure(text), chunking.formulas_in_sentences(text)
    assert time.perf_counter() - clock < 20


def united(regions, gap):
    """Regions united until none is within the gap of another, in any order."""
    regions = [(a, b, frozenset([k] if isinstance(k, int) and k else k or [])) for a, b, k in regions]
    while True:
        pair = next(((x, y) for i, x in enumerate(regions) for y in regions[i + 1 :] if x[0] <= y[1] + gap and y[0] <= x[1] + gap), None)
        if pair is None:
            return sorted(regions)
        x, y = pair
        regions.remove(x)
        regions.remove(y)
        regions.append((min(x[0], y[0]), max(x[1], y[1]), x[2] | y[2]))


@pytest.mark.parametrize("seed", range(20))
def test_kinds_of_regions(seed):
    text = text_of(seed, 30 + 20 * seed)
    formulas = united(chunking.formula_regions(text), 10)
    examples = united(chunking.example_regions(text), 0)
    want = united([*formulas, *chunking.definition_regions(text), *examples], 20)
    assert [(a, b, sum(kinds)) for a, b, kinds in want] == chunking.protected_kinds(text)
    names = ((1, "math"), (2, "definition"), (4, "example"))
    first = lambda a, b: next((next(n for k, n in names if k in kinds) for x, y, kinds in want if x < b and y > a and kinds), "text")
    found = chunking.by_structure_with_kinds(text)
    assert [c[:3] for c in found] == chunking.by_structure(text)
    if len(text.strip()) >= 300:
        assert [c[3:5] for c in found] == [(first(a, b), first(0, len(c))) for a, b, c, *_ in found]
        assert [c[5] for c in found] == [sum(x < b and y > a for x, y, _ in want) for a, b, *_ in found]


def test_worked_kinds():
    kinds = lambda text: [c[3] for c in chunking.by_structure_with_kinds(text)]
    filler = "Plain words stand here. " * 60
    assert kinds(filler) == ["text"] * len(kinds(filler))
    assert kinds("Some $a + b$ here. " + filler)[0] == "math" and kinds("Some $a + b$ here. " + filler)[-1] == "text"
    assert kinds("A Graph is defined as a set. " + filler)[0] == "definition"
    assert kinds("Example 3: take this. " + filler)[0] == "example"
    assert kinds("A value f(x) = y. " + filler)[0] == "text"
    assert kinds("A Graph is defined as $a$. " + filler)[0] == "math"
    assert kinds("Example $a$") == ["text"] and kinds("") == [] and kinds(" \n ") == []
    late = filler + "Example 3: take this. " + filler
    assert [c[3:5] for c in chunking.by_structure_with_kinds(late)][0] == ("text", "text")


def test_blank_and_missing_texts_have_no_chunks(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, " \n ")], "k long, text string")
    for some in (rows, rows.where("k > 9")):
        found = chunking.chunks(some, ["k"], "text", chunking.by_structure_with_kinds, chunking.KIND_COLUMNS)
        assert found.columns == ["k", "chunk_no", "begin", "finish", "chunk", "kind", "kind_from_start", "regions"] and found.collect() == []


def test_sections_cut_in_tasks(spark):
    """As if each section were a text of its own; a book without elements is one section."""
    lines = ["Chapter 1: Introduction", "1.2 Worked example", "A. First steps", "ii. minor point", "Ünïcode wörds here. " * 30, "For example, take α + β = γ. " * 20, "Let a be a set. We define it. " * 25]
    rng = random.Random(12)
    books = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 60)))) for k in range(20)] + [(20, "Plain words. " * 200), (21, None), (22, "")]
    books = spark.createDataFrame(books, "book_id long, text string")
    found = chunking.chunks_of_sections(books, chunking.by_structure)
    want = chunking.chunks(chunking.sections(books), ["book_id", "section"], "text", chunking.by_structure)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.where("book_id = 20").count() > 1


@pytest.mark.parametrize("seed", range(8))
def test_places_are_those_of_the_patterns(seed):
    bits = ["For instance, ", "EX.", "exercise", "For\nexample", "Consider the following", "ſuppose the case", "İ", "ı", "We  have", "Solution:", "hence", "we ", "pro", "blem", "ex", "le", " word ", ". "]
    rng = random.Random(seed)
    for some in (bits, [b for b in bits if b.isascii()]):
        text = "".join(rng.choice(some) for _ in range(300))
        for pattern, marks in ((chunking._EXAMPLE, chunking._EXAMPLE_BEGINS), (chunking._SOLUTION, chunking._SOLUTION_BEGINS)):
            assert chunking._begins(pattern, text, chunking._small(text), marks) == [m.start() for m in pattern.finditer(text)]
