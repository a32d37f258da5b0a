"""Language identification of texts that may mix languages.

The script of a word narrows its candidate languages; each candidate scores the word by its character
n-grams; Viterbi with a penalty for each switch then labels the words of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codes_of, map_arrow, offsets_of, slices, small_batches, strings, sums_by, table, words_of

#: Documents of each language that the model is fitted on, about; chosen by a hash of their id.
SAMPLE_DOCUMENTS = 3000
BUCKETS = 1 << 14
NGRAMS = (1, 2, 3)
#: Log-likelihood that a switch of language costs, on the scale of WEIGHT per n-gram.
SWITCH_PENALTY = 8.0
WEIGHT = 0.5
#: A language uses a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.01
#: First and last code points of scripts; letters elsewhere count as script 1.
SCRIPTS = (
    ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)),  # Latin
    ((0x370, 0x3FF), (0x1F00, 0x1FFF)),  # Greek
    ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),  # Cyrillic
    ((0x531, 0x58F),),  # Armenian
    ((0x591, 0x5F4),),  # Hebrew
    ((0x610, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)),  # Arabic
    ((0x900, 0x963), (0x971, 0x97F)),  # Devanagari
    ((0x980, 0x9FF),),  # Bengali
    ((0xB80, 0xBFF),),  # Tamil
    ((0xE01, 0xE4E),),  # Thai
    ((0x10A0, 0x10FF),),  # Georgian
    ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),  # Hangul
    ((0x3041, 0x30FF), (0x31F0, 0x31FF)),  # Kana
    ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),  # Han
)
N_SCRIPTS = len(SCRIPTS) + 2


def _script_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for k, ranges in enumerate(SCRIPTS):
        for first, last in ranges:
            out[first : last + 1] = k + 2
    return out


_SCRIPT = _script_table()


class _Words:
    """Distinct words in lower case as code points between marks, with their scripts (0: no letter)."""

    def __init__(self, distinct: pa.Array):
        lower = pc.utf8_lower(distinct)
        text = "\x02" + "\x02".join(lower.to_pylist()) + "\x02"
        self.points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
        self.begin = offsets_of(sizes + 1)  # of the mark before each word
        self.n = len(distinct)
        letters = pc.match_substring_regex(lower, "\\p{L}").to_numpy(zero_copy_only=False)
        scripts = np.maximum.reduceat(_SCRIPT[self.points], self.begin[:-1]) if self.n else np.zeros(0, np.uint8)
        self.script = np.where(letters, np.maximum(scripts, 1), 0)
        self.letters = np.where(letters, sizes, 0)

    def ngrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Word and bucket of each n-gram of the words, marks included."""
        word = np.repeat(np.arange(self.n), np.diff(self.begin))  # of each position but the last mark
        words, buckets = [], []
        for n in NGRAMS:
            begin = np.arange(len(self.points) - n + 1)
            owner = word[np.minimum(begin, len(word) - 1)] if len(word) else begin[:0]
            begin = begin[: len(owner)]
            # An n-gram may hold the marks on either side of its word and no more.
            inside = begin + n - 1 <= self.begin[owner + 1]
            begin, owner = begin[inside & (begin < self.begin[-1])], owner[inside & (begin < self.begin[-1])]
            code = np.full(len(begin), n, np.uint64)
            for k in range(n):
                code = code * np.uint64(0x9E3779B97F4A7C15) + self.points[begin + k].astype(np.uint64)
                code ^= code >> np.uint64(31)
            words.append(owner)
            buckets.append((code % np.uint64(BUCKETS)).astype(np.int64))
        return np.concatenate(words), np.concatenate(buckets)


class Model:
    """Languages in order, log-probabilities of n-gram buckets, and which scripts each language uses."""

    def __init__(self, languages: list[str], scores: np.ndarray, uses: np.ndarray):
        self.languages, self.scores, self.uses = languages, scores, uses

    def word_scores(self, words: _Words) -> np.ndarray:
        """A score for each word and language; words without letters score 0 throughout."""
        owner, bucket = words.ngrams()
        out = np.zeros((words.n, len(self.languages)), np.float32)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.scores[bucket, k], minlength=words.n)
        out *= WEIGHT
        barred = ~self.uses[words.script]
        barred[~self.uses[words.script].any(axis=1)] = False  # a script that no language uses bars none
        out[barred] -= 50
        out[words.script == 0] = 0
        return out


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Fits the model on labelled documents that are not held out, about `sample` of each language.

    Counting is done in tasks; what comes to the driver is a count for each language and bucket.
    """
    small_batches(docs.sparkSession)
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((N_SCRIPTS, 0), bool))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, int(min(1.0, sample / sizes[k]) * 1_000_000))))
    chosen = usable.where(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(1_000_000)) < share[F.col(lang_col)])
    number = {k: i for i, k in enumerate(languages)}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(number), BUCKETS + N_SCRIPTS), np.int64)
        for batch in slices(batches):
            flat, offsets = words_of(strings(batch.column(1)))
            codes, distinct = codes_of(flat)
            words = _Words(distinct)
            if not words.n:
                continue
            owner, bucket = words.ngrams()
            lang = np.repeat(np.array([number[x] for x in batch.column(0).to_pylist()]), np.diff(offsets))
            for k in np.unique(lang):
                times = np.bincount(codes[lang == k], minlength=words.n)
                lettered = times * (words.script > 0)
                counts[k, :BUCKETS] += np.bincount(bucket, lettered[owner], minlength=BUCKETS).astype(np.int64)
                counts[k, BUCKETS:] += np.bincount(words.script, times * words.letters, minlength=N_SCRIPTS).astype(np.int64)
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(k, pa.int64()), "bucket": pa.array(b, pa.int64()), "n": pa.array(counts[k, b])})

    rows = map_arrow(chosen.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")), task, "lang long, bucket long, n long")
    counts = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    for r in rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["bucket"], r["lang"]] = r["n"]
    ngrams, scripts = counts[:BUCKETS], counts[BUCKETS:]
    scores = np.log((ngrams + 0.5) / (ngrams.sum(axis=0) + 0.5 * BUCKETS))
    uses = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=0), 1)
    uses[0] = True
    return Model(languages, scores.astype(np.float32), uses)


def viterbi(scores: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word of several texts; all texts advance together, a word at a time.

    Values are kept relative to the best one, so that they do not lose digits however long a text is.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    begin, length = offsets[:-1][order], lengths[order]
    active = len(length) - np.searchsorted(length[::-1], np.arange(length[0] if len(length) else 0), side="right")
    came = np.zeros(scores.shape, np.int16)
    best = np.zeros(len(scores), np.int16)
    if not len(order):
        return best
    value = scores[begin].astype(np.float64)
    every = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, len(active)):
        k = active[t]
        now = value[:k]
        top = now.argmax(axis=1)
        behind = now - now[np.arange(k), top][:, None]
        at = begin[:k] + t
        came[at] = np.where(behind < -penalty, top[:, None].astype(np.int16), every)
        value[:k] = np.maximum(behind, -penalty) + scores[at]
    state = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        best[at] = state[:k]
        if t:
            state[:k] = came[at, state[:k]]
    return best


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY, with_spans: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, n_spans and, if asked for, the spans (lang, first word, word after the last).

    The prediction is the language with most characters in words with letters (ties: the first by name), the score its share of them.
    A text that is null or has no letter is `und` with score 0 and no span, as all are if no language was
    learned.  Words without letters stand with their neighbours.  Ids may be null or repeat; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers for each language

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        names = np.array([*model.languages, "und"], object)
        for batch in slices(batches):
            flat, offsets = words_of(strings(batch.column(1)))
            codes, distinct = codes_of(flat)
            n, many = batch.num_rows, len(model.languages)
            letters = np.zeros((n, many + 1), np.int64)
            spans = np.zeros(0, np.int64)
            label = np.zeros(len(codes), np.int16)
            if len(codes) and many:
                words = _Words(distinct)
                label = viterbi(model.word_scores(words)[codes], offsets, penalty)
                for k in range(many):
                    letters[:, k] = sums_by(np.where(label == k, words.letters[codes], 0), offsets)
                doc = np.repeat(np.arange(n), np.diff(offsets))
                new = np.ones(len(codes), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
                spans = np.flatnonzero(new)
            total = letters.sum(axis=1)
            known = total > 0
            top = np.where(known, letters[:, :many].argmax(axis=1) if many else many, many)
            share = np.where(known, letters[np.arange(n), top] / np.maximum(total, 1), 0.0)
            edges = np.searchsorted(spans, offsets)
            counts = np.where(known, np.diff(edges), 0)
            out = {"doc_id": batch.column(0), "lang_pred": pa.array(names[top], pa.string()), "score": pa.array(share), "n_spans": pa.array(counts, pa.int64())}
            if with_spans:
                ends = np.append(spans[1:], len(codes))
                rows = [[{"lang": names[label[spans[j]]], "begin": int(spans[j] - offsets[i]), "end": int(ends[j] - offsets[i])} for j in range(edges[i], edges[i + 1])] if known[i] else [] for i in range(n)]
                out["spans"] = pa.array(rows, pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, lang_pred string, score double, n_spans long" + ", spans array<struct<lang:string,begin:long,end:long>>" * with_spans)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "n_spans")
