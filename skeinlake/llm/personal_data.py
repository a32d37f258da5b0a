"""Personal data in texts: patterns, and a character tagger that adds what they cannot match.

The tagger is trained on windows of a bounded sample, labelled by the spans that the patterns found there, as they are and
respelled: "jo at example dot com", cards with other separators or next to each other, phones without a plus sign,
addresses with brackets around their dots.  Windows that hold a failed match of a pattern are not shown to it.

Windows lie around digits, at signs and written-out signs ("[at]", " dot "); text without these, as a name alone or
a number in words, is never tagged.  Windows overlap; each place takes the scores of the window it lies most
central in, and the scores of a whole zone are decoded as one chain, so that tags agree across windows.  They are
then read as spans, checked, and dropped where they meet a span of the patterns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .char_tagger import OTHER, PAD, Tagger, class_table
from .common import map_arrow, slices, small_batches, stage, strings, table

KINDS = ("email", "ip", "card", "phone")
#: The parts of the kinds' patterns.  None of them is ever tried twice at a place, so that time is linear in the text.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Windows of a segment of a very long zone, those that it shares with the next one, and windows whose scores a task holds.
STRETCH, OVERLAP = 1024, 8
WINDOWS_AT_ONCE = 4096
#: Where the tagger looks.
TRIGGER = r"[0-9@]|[ (\[](?:dot|DOT)[ )\]]|[(\[](?:at|AT)[)\]]"
_TRIGGER = re.compile(TRIGGER)

WINDOW = 64
REACH = 32
#: Documents that training looks at, about, and windows it uses at most.
TRAIN_DOCUMENTS = 4000
TRAIN_WINDOWS = 1800
#: Respelled copies of each labelled span, and spans of one text that are respelled at most, evenly spaced.
RESPELLED = 4
SPANS_OF_A_TEXT = 200
STEPS = 550
#: A span of the tagger counts if its tags' mean probability is at least this.
CONFIDENCE = 0.9
PLACEHOLDER = "<{}>"
_CLASS = class_table()


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _holds(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))
    digits = "".join(c for c in text if "0" <= c <= "9")
    return 8 <= len(digits) <= 15 if kind == "phone" else 16 <= len(digits) <= 19 and _luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: an at sign has one run of characters before it, and at most one domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield begin, end
        at = text.find("@", max(at + 1, end))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers each of a run of numbers with single dots between."""
    for m in _NUMBERS.finditer(text):
        if m.group().count(".") < 3:
            continue
        ends = [n.span() for n in re.finditer("[0-9]++", m.group())]
        for k in range(0, len(ends) - 3, 4):
            yield m.start() + ends[k][0], m.start() + ends[k + 3][1]


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of all matches of the patterns by kind, then start, whether they hold or not."""
    if "@" in text:
        yield from ((0, a, b) for a, b in _emails(text))
    yield from ((1, a, b) for a, b in _addresses(text))
    yield from ((2, *m.span()) for m in _CARD.finditer(text))
    if "+" in text:
        yield from ((3, *m.span()) for m in _PHONE.finditer(text))


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that the patterns find, by kind, then start."""
    return [(k, a, b) for k, a, b in matches(text) if _holds(KINDS[k], text[a:b])]


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(points < 256, _CLASS[np.minimum(points, 255)], OTHER).astype(np.uint8)


def zones_of(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs, joined where they meet."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.start() + REACH + 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes over the zones, half overlapping, and their starts."""
    classes = np.concatenate((classes_of(text), np.full(WINDOW, PAD, np.uint8)))
    starts = [s for a, b in zones_of(text) for s in range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2)]
    starts = np.array(starts, np.int64)
    return classes[starts[:, None] + np.arange(WINDOW)], starts


def tags_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """0 outside, 2 k + 1 where a span of kind k begins, 2 k + 2 inside it; the first of overlapping spans counts."""
    tags = np.zeros(length, np.int8)
    for k, a, b in sorted(spans, key=lambda s: s[1]):
        if not tags[a:b].any():
            tags[a:b] = 2 * k + 2
            tags[a] = 2 * k + 1
    return tags


def respell(kind: str, span: str, rng: np.random.Generator) -> list[tuple[str, str]]:
    """The span in a spelling that the patterns miss, as pieces (kind or nothing, text)."""
    pick = lambda *some: some[int(rng.integers(len(some)))]
    if kind == "email":
        local, domain = span.rsplit("@", 1)
        # Not all have a number, or the sample's top-level domain.
        local, domain = (re.sub("[.0-9]*[0-9]", "", x) or "a" if rng.integers(2) else x for x in (local, domain))
        domain = domain.rsplit(".", 1)[0] + pick(".com", ".org", ".net", ".de", ".co.uk", ".io")
        return [(kind, local + pick(" at ", " (at) ", "[at]", " [at] ", "(at)") + domain.replace(".", pick(" dot ", " (dot) ", "[dot]", " [dot] ")))]
    if kind == "ip":
        return [(kind, span.replace(".", pick("[.]", "(.)", " . ", "[dot]", " dot ")))]
    digits = re.sub("[^0-9]", "", span)
    if kind == "card":
        if rng.integers(3) == 0:  # two in a row are one match, too long for a card
            return [(kind, span), ("", " "), (kind, span)]
        return [(kind, pick(".", "/", "_", " - ", "  ").join(digits[i : i + 4] for i in range(0, len(digits), 4)))]
    if rng.integers(3) == 0:  # a number behind it that the pattern takes for a part of the phone
        return [(kind, span), ("", " "), ("ip", ".".join(str(x) for x in rng.integers(0, 256, 4)))]
    a, b, c = digits[:-7], digits[-7:-4], digits[-4:]
    return [(kind, pick(f"({a[-3:]}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"{a}/{b}-{c}"))]


def _labelled_windows(text: str, spans: list[tuple[int, int, int]], banned: list[tuple[int, int]]) -> Iterator[tuple[int, bytes, bytes]]:
    """(a kind in it or -1, classes, tags) of the windows of a text that touch no banned stretch."""
    found, starts = windows_of(text)
    tags = np.concatenate((tags_of(len(text), spans), np.zeros(WINDOW, np.int8)))
    stop = np.zeros(len(text) + WINDOW + 1, np.int64)
    for a, b in banned:
        stop[a + 1 : b + 1] = 1
    stop = np.cumsum(stop)
    for x, s in zip(found, starts.tolist(), strict=True):
        if stop[s + WINDOW] == stop[s]:
            y = tags[s : s + WINDOW]
            yield int(y.max() - 1) // 2 if y.any() else -1, x.tobytes(), y.tobytes()


def training_windows(text: str, respelled: int = RESPELLED) -> set[tuple[int, bytes, bytes]]:
    """The labelled windows of a text: (group, classes, tags); groups are a kind, a kind respelled, or neither."""
    every = [(k, a, b, _holds(KINDS[k], text[a:b])) for k, a, b in matches(text)]
    good = [(k, a, b) for k, a, b, holds in every if holds]
    taken = np.zeros(len(text) + 1, bool)
    for _, a, b in good:
        taken[a:b] = True
    # Long numbers that fail a check may be personal data all the same.
    unsure = [(a, b) for k, a, b, holds in every if not holds and b - a >= 7 and not taken[a:b].all()]
    out = set(_labelled_windows(text, good, unsure))
    for n, (k, a, b) in list(enumerate(good))[:: len(good) // SPANS_OF_A_TEXT + 1]:
        rng = np.random.default_rng([n, a, b])
        for _ in range(respelled):
            left, right = text[max(0, a - WINDOW) : a], text[b : b + WINDOW]
            new, spans = left, []
            for kind, piece in respell(KINDS[k], text[a:b], rng):
                if kind:
                    spans.append((KINDS.index(kind), len(new), len(new) + len(piece)))
                new += piece
            others = [(x, y) for _, x, y in matches(left)] + [(len(new) + x, len(new) + y) for _, x, y in matches(right)]
            out |= {(k + len(KINDS), x, y) for g, x, y in _labelled_windows(new + right, spans, others) if g >= 0}
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", documents: int = TRAIN_DOCUMENTS, windows: int = TRAIN_WINDOWS, steps: int = STEPS) -> Tagger | None:
    """Trains on at most `windows` windows of about `documents` documents with a digit or at sign; None without any.

    A tenth of the windows at most have each kind as it is, as many have it respelled, and the others have none.  Which ones are
    taken depends on their own hashes alone.
    """
    small_batches(docs.sparkSession)
    usable = docs.where(F.col(text_col).rlike(TRIGGER))
    n = docs.count()
    # About a tenth of texts and more have a trigger; the bound is on texts looked at.
    share = int(min(1.0, documents * 4 / max(n, 1)) * 1_000_000)
    chosen = usable.where(F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.lit("pii")), F.lit(1_000_000)) < share)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = sorted({row for text in batch.column(0).to_pylist() for row in training_windows(text)})
            yield pa.RecordBatch.from_pydict({"g": pa.array([r[0] for r in rows], pa.int32()), "x": pa.array([r[1] for r in rows], pa.binary()), "y": pa.array([r[2] for r in rows], pa.binary())})

    found = map_arrow(chosen.select(F.col(text_col).cast("string").alias("text")), task, "g int, x binary, y binary").distinct()
    order = Window.partitionBy("g").orderBy(F.xxhash64("x", "y"), "x", "y")
    limit = F.when(F.col("g") < 0, windows - 2 * len(KINDS) * (windows // 10)).otherwise(windows // 10)
    rows = found.withColumn("rank", F.row_number().over(order)).where((F.col("rank") <= windows) & (F.col("rank") <= limit)).orderBy("g", "rank").collect()  # `windows` rows at most
    if not any(r["g"] >= 0 for r in rows):
        return None
    x = np.stack([np.frombuffer(r["x"], np.uint8) for r in rows])
    y = np.stack([np.frombuffer(r["y"], np.int8) for r in rows]).astype(np.int64)
    tagger = Tagger(2 * len(KINDS) + 1)
    tagger.fit(x, y, steps)
    return tagger


def _segments(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of windows that are decoded together: those of a zone; of a very long one, stretches that overlap."""
    edges = np.flatnonzero(np.diff(starts) != WINDOW // 2) + 1
    out = []
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(starts)], strict=True):
        while b - a > STRETCH + OVERLAP:
            out.append((a, a + STRETCH + OVERLAP))
            a += STRETCH
        if b > a:
            out.append((a, b))
    return out


def _joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, tags and probabilities of segments of a text as one sequence.

    Where segments overlap, one is left for the other at the place nearest to the middle at which both have the same tag, so that the whole is
    a sequence of tags that the chain allows.
    """
    pieces = [parts[0]]
    for place, tag, p in parts[1:]:
        last, tags, q = pieces[-1]
        common = int(np.searchsorted(last, place[0]))
        n = len(last) - common
        if n > 0:
            same = np.flatnonzero(tags[common:] == tag[:n])
            at = int(same[np.abs(same - n // 2).argmin()]) if len(same) else n // 2
            pieces[-1] = last[: common + at], tags[: common + at], q[: common + at]
            place, tag, p = place[at:], tag[at:], p[at:]
        pieces.append((place, tag, p))
    place, tag, p = (np.concatenate(x) for x in zip(*pieces, strict=True))
    return place, tag, p


def tagger_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[int, int, int]]]:
    """Spans of the tagger in each text, by start.

    Each place has the scores of the window it lies most central in; the scores of a zone are decoded as one chain.
    """
    out: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in texts]
    batch: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        x, starts = windows_of(text)
        for a, b in _segments(starts):
            own = np.zeros((b - a, WINDOW), bool)
            own[:, WINDOW // 4 : 3 * WINDOW // 4] = True
            own[0, : WINDOW // 4] |= a == 0 or starts[a] - starts[a - 1] != WINDOW // 2
            own[-1, 3 * WINDOW // 4 :] |= b == len(starts) or starts[b] - starts[b - 1] != WINDOW // 2
            places = starts[a:b, None] + np.arange(WINDOW)
            batch.append((i, x[a:b], places, own & (places < len(text))))
            size += b - a
            if size >= WINDOWS_AT_ONCE:
                _decode(batch, tagger, out)
                batch, size = [], 0
    _decode(batch, tagger, out)
    return [_read(text, *_joined(parts)) if parts else [] for text, parts in zip(texts, out, strict=True)]


def _decode(batch: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], tagger: Tagger, out: list[list]) -> None:
    """Adds places, tags and probabilities of segments (text, windows, places, own places) to their texts."""
    if not batch:
        return
    every, back = np.unique(np.concatenate([x for _, x, _, _ in batch]), axis=0, return_inverse=True)
    scores = np.concatenate([tagger.scores(some) for some in np.array_split(every, len(every) // WINDOWS_AT_ONCE + 1)])  # alike windows once
    own = np.concatenate([m for _, _, _, m in batch])
    lengths = np.array([m.sum() for _, _, _, m in batch])
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    tags = tagger.best(scores[back][own], offsets)
    spread = np.zeros(own.shape, np.int8)
    spread[own] = tags
    sure = np.ones(own.shape, np.float32)
    if len(some := np.flatnonzero(spread.any(axis=1))):
        held = np.unique(back[some])
        marginal = tagger.marginals(scores[held])
        at = np.searchsorted(held, back[some])
        sure[some] = np.take_along_axis(marginal[at], spread[some][:, :, None].astype(np.int64), 2)[:, :, 0]
    p = sure[own]
    for k, (i, _, places, mask) in enumerate(batch):
        cut = slice(offsets[k], offsets[k + 1])
        out[i].append((places[mask], tags[cut], p[cut]))


def _read(text: str, place: np.ndarray, tag: np.ndarray, p: np.ndarray) -> list[tuple[int, int, int]]:
    """The spans that tags at ascending places tell, as far as they are sure and hold."""
    spans = []
    inner = np.append(tag, 0)
    follows = np.append(np.diff(place) == 1, False)
    for i in np.flatnonzero(tag % 2 == 1).tolist():
        k, j = int(tag[i] - 1) // 2, i + 1
        while inner[j] == 2 * k + 2 and follows[j - 1]:
            j += 1
        a, b = int(place[i]), int(place[j - 1]) + 1
        if p[i:j].mean() >= CONFIDENCE and _plausible(KINDS[k], text[a:b]):
            spans.append((k, a, b))
    return spans


def _plausible(kind: str, text: str) -> bool:
    """What any spelling of the kind must have."""
    if kind == "email":
        return "@" in text[1:-1] or re.search(r"[ (\[]at[ )\]].*\b(?:dot\b|\.)", text, re.I | re.S) is not None
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    return 8 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and _luhn(digits)


def find(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text", redact: bool = False) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans; with `redact` the input's columns, spans replaced by the kind's name.

    The counts are those of the patterns' spans, as base_sha256 is; `spans` holds the tagger's as well.  Null texts
    are empty (and stay null when redacted); time is linear in a text's length, whatever it holds.  Ids may be null or repeat; other columns are ignored, or kept with `redact`.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tagger)  # a few thousand numbers
    rest = [c for c in docs.columns if c not in (id_col, text_col)] if redact else []
    none = hashlib.sha256(b"").hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, texts = batch.num_rows, strings(batch.column(1))
            some = np.flatnonzero(pc.match_substring_regex(texts, TRIGGER).to_numpy(zero_copy_only=False))
            own = texts.take(pa.array(some)).to_pylist()
            added = tagger_spans(own, sent.value) if sent.value is not None else [[] for _ in own]
            counts = np.zeros((n, len(KINDS)), np.int64)
            digest, listed = [none] * n, [""] * n
            changed = {}
            for i, text, more in zip(some.tolist(), own, added, strict=True):
                base = pattern_spans(text)
                for k, _, _ in base:
                    counts[i, k] += 1
                digest[i] = hashlib.sha256(_list(base).encode()).hexdigest()
                taken = np.zeros(len(text) + 1, bool)
                for _, a, b in base:
                    taken[a:b] = True
                every = sorted(base + [s for s in more if not taken[s[1] : s[2]].any()])
                listed[i] = _list(every)
                if redact and every:
                    changed[i] = _replace(text, every)
            if redact:
                new = batch.column(1).to_pylist() if changed else None
                for i, text in changed.items():
                    new[i] = text
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string()) if changed else batch.column(1), *batch.columns[2:]], ["_id", "_text", *(f"_c{k}" for k in range(len(rest)))])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digest), pa.array(listed)], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(rest)))
    if not redact:
        return rows.mapInArrow(task, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
    kinds = dict(docs.dtypes)
    out = rows.mapInArrow(task, "_id long, _text string" + "".join(f", _c{k} {kinds[c]}" for k, c in enumerate(rest)))
    held = {id_col: "_id", text_col: "_text"} | {c: f"_c{k}" for k, c in enumerate(rest)}
    return out.select(*(F.col(held[c]).cast(kind).alias(c) for c, kind in docs.dtypes))


def _list(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _replace(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    parts, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            parts += [text[at:a], PLACEHOLDER.format(KINDS[k].upper())]
        at = max(at, b)
    return "".join(parts) + text[at:]


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
