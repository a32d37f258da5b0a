"""Quality rules with the frequency of lines across documents.

A first reading hashes the normalised lines of each text.  For each host, the distinct documents of each line are counted;
lines above the limits are boilerplate.  A second reading computes the rules of each text, removes its
boilerplate lines and rejects documents that this leaves depleted.

Copies of a document must not make its lines boilerplate.  A document is therefore known by a digest of its whole text,
which copies share and no other document has: the limits are on different digests, of the documents with a line
and of all documents of the host, so that copies count once on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import codes_of, hashes_of, map_arrow, offsets_of, ranks_of_windows, slices, small_batches, stage, strings, sums_by, table, words_of

SYMBOLS = "[#*$%&|<>]"
REPEAT_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
#: A line is boilerplate above so many distinct documents of a host, and above this share of its distinct documents.
LINE_DOCUMENTS = 50
LINE_SHARE = 0.005
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.3
#: Boilerplate lines that are sent to all tasks (16 bytes each); more of them are joined to their documents.
BROADCAST_LINES = 1_000_000


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Lines:
    """Lines of texts: which hold a word, their hashes when normalised, their numbers of words."""

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern(texts, "\n")
        self.flat = parts.flatten()
        self.offsets = offsets_of(pc.list_value_length(parts).to_numpy(zero_copy_only=False))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        codes, distinct = codes_of(self.flat)
        self.codes, self.distinct = codes, distinct
        words, offsets = words_of(distinct)
        self.words = np.diff(offsets)[codes]
        # Normalised: words in lower case with runs of digits as 0, whatever white space is between them.
        of_word, different = codes_of(words)
        normal = pc.replace_substring_regex(pc.utf8_lower(different), "[0-9]+", "0")
        place = np.arange(len(words)) - np.repeat(offsets[:-1], np.diff(offsets))
        powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _FACTOR))
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(hashes_of(normal)[of_word] * powers[place], out=total[1:])
        mixed = total[offsets[1:]] - total[offsets[:-1]]
        self.hashes = ((mixed ^ (mixed >> np.uint64(29))) * _FACTOR)[codes].view(np.int64)


def line_counts(docs: DataFrame, host_col: str, text_col: str) -> DataFrame:
    """host, line and distinct documents for each line of at least one word; for a null line, those of the whole host."""
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            texts = strings(batch.column(1))
            digest = hashes_of(texts).view(np.int64)
            lines = _Lines(texts)
            some = lines.words > 0
            doc, line = lines.doc[some], lines.hashes[some]
            order = np.lexsort((line, doc))
            doc, line = doc[order], line[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])
            doc, line = np.concatenate((doc[new], np.arange(batch.num_rows))), line[new]
            line = pa.concat_arrays([pa.array(line), pa.nulls(batch.num_rows, pa.int64())])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), line, pa.array(digest[doc])], ["host", "line", "digest"])

    rows = map_arrow(docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text")), task, "host string, line long, digest long")
    # Copies meet before the shuffle: one row for each line, digest and task.
    return rows.distinct().groupBy("host", "line").agg(F.count("*").alias("documents"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE) -> DataFrame:
    """host and line (a hash) of the lines above the limits.  A null host is a host of its own."""
    counts = line_counts(docs, host_col, text_col)
    counts = stage(counts.where((F.col("documents") > documents) | F.col("line").isNull()), "line-counts")
    hosts = counts.where("line IS NULL").select(F.col("host").alias("h"), F.col("documents").alias("all"))
    lines = counts.where("line IS NOT NULL")
    return lines.join(hosts, F.col("host").eqNullSafe(F.col("h"))).where(F.col("documents") > share * F.col("all")).select("host", "line")


def rules_of(texts: pa.Array, hosts: list, bad: dict) -> tuple[dict, _Lines, np.ndarray]:
    """The columns of the rules; the lines, and which of them are boilerplate."""
    n = len(texts)
    words, offsets = words_of(texts)
    counts = np.diff(offsets)
    codes, distinct = codes_of(words)
    points = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = _Lines(texts)

    some = np.flatnonzero(lines.words > 0)
    order = some[np.lexsort((some, lines.codes[some], lines.doc[some]))]
    again = np.zeros(len(lines.codes), np.int64)
    again[order[1:]] = (lines.doc[order][1:] == lines.doc[order][:-1]) & (lines.codes[order][1:] == lines.codes[order][:-1])

    ranks = ranks_of_windows(codes, REPEAT_WORDS)
    doc = np.repeat(np.arange(n), counts)
    at = np.flatnonzero(offsets[1:][doc[: len(ranks)]] - np.arange(len(ranks)) >= REPEAT_WORDS)
    repeated = np.zeros(0, np.int64)
    if len(at):
        key = ranks[at] * n + doc[at]
        _, codes_in, times = np.unique(key, return_inverse=True, return_counts=True)
        repeated = at[times[codes_in] > 1]
    cover = np.zeros(len(codes) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + REPEAT_WORDS, -1)

    removed = np.zeros(len(lines.codes), bool)
    if bad:
        for i, host in enumerate(hosts):
            if (known := bad.get(host)) is not None:
                a, b = lines.offsets[i : i + 2]
                place = np.minimum(np.searchsorted(known, lines.hashes[a:b]), len(known) - 1)
                removed[a:b] = (known[place] == lines.hashes[a:b]) & (lines.words[a:b] > 0)
    left = counts - sums_by(np.where(removed, lines.words, 0), lines.offsets)
    n_repeat = sums_by((np.cumsum(cover)[:-1] > 0).astype(np.int64), offsets)
    failed = (counts < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * counts)
    columns = {
        "n_words": counts,
        "word_chars": sums_by(points[codes] if len(codes) else codes, offsets),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": sums_by(again, lines.offsets),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "n_left": left,
        "kept": ~failed & (left >= LEAST_LEFT * counts),
    }
    return columns, lines, removed


_RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_left long, kept boolean"


def judge(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", documents: int = LINE_DOCUMENTS, share: float = LINE_SHARE, with_text: bool = False) -> DataFrame:
    """A row for each row: its id, the rules' columns, whether it is kept and, if asked for, its text without boilerplate.

    Null texts are empty and fail the base rules, as all texts of fewer than LEAST_WORDS words do.  Ids may be
    null or repeat.  With `with_text`, all other columns are kept as well; else they are ignored.
    """
    spark = docs.sparkSession
    lines = stage(boilerplate(docs, host_col, text_col, documents, share), "boilerplate")
    small_batches(spark)
    fits = lines.count() <= BROADCAST_LINES
    rest = [c for c in docs.columns if c not in (id_col, host_col, text_col)] if with_text else []
    more = [F.col(c).alias(f"_c{k}") for k, c in enumerate(rest)]
    fixed = [F.col(id_col).cast("long").alias("_id"), F.col(host_col).cast("string").alias("_host"), F.col(text_col).cast("string").alias("_text")]
    if fits:
        known: dict = {}
        for row in lines.collect():  # BROADCAST_LINES rows at most
            known.setdefault(row["host"], []).append(row["line"])
        sent = spark.sparkContext.broadcast({h: np.sort(np.array(v, np.int64)) for h, v in known.items()})
        rows = docs.select(*fixed, F.lit(None).cast("array<long>").alias("_bad"), *more)
    else:
        sent = None
        numbered = stage(docs.select(*fixed, F.monotonically_increasing_id().alias("_uid"), *more), "rows")
        bad = lines.select(F.col("host").alias("_h"), F.col("line").alias("_l"))
        own = _lines_of(numbered).join(bad, F.col("host").eqNullSafe(F.col("_h")) & (F.col("line") == F.col("_l")))
        own = own.groupBy("uid").agg(F.collect_set("line").alias("_bad"))
        rows = numbered.join(own, F.col("_uid") == F.col("uid"), "left").select("_id", "_host", "_text", "_bad", *(f"_c{k}" for k in range(len(rest))))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            texts, hosts, bad = strings(batch.column(2)), batch.column(1).to_pylist(), {}
            if sent is None:  # each row brings its own lines
                own = batch.column(3).to_pylist()
                hosts = list(range(len(hosts)))
                bad = {i: np.sort(np.array(x, np.int64)) for i, x in enumerate(own) if x}
            else:
                bad = sent.value
            columns, lines, removed = rules_of(texts, hosts, bad)
            arrays = [batch.column(0), *(pa.array(x) for x in columns.values())]
            names = ["doc_id", *columns]
            if with_text:
                stays = pa.array(~removed)
                places = offsets_of(sums_by((~removed).astype(np.int64), lines.offsets)).astype(np.int32)
                cut = pc.binary_join(pa.ListArray.from_arrays(pa.array(places), lines.flat.filter(stays).cast(pa.string())), "\n")
                arrays += [batch.column(1), pc.if_else(pc.is_null(batch.column(2)), pa.scalar(None, pa.string()), cut), *(batch.column(k) for k in range(4, 4 + len(rest)))]
                names += ["_host", "_text", *(f"_c{k}" for k in range(len(rest)))]
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, " + _RULES
    if with_text:
        kinds = dict(docs.dtypes)
        schema += ", _host string, _text string" + "".join(f", _c{k} {kinds[c]}" for k, c in enumerate(rest))
    return rows.mapInArrow(task, schema)


def _lines_of(numbered: DataFrame) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            lines = _Lines(strings(batch.column(2)))
            doc = pa.array(lines.doc)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(doc), batch.column(1).take(doc), pa.array(lines.hashes)], ["uid", "host", "line"])

    return numbered.select(F.col("_uid").alias("uid"), F.col("_host").alias("host"), "_text").mapInArrow(task, "uid long, host string, line long").distinct()


def keep_good(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents that are kept, without their boilerplate lines, with all their columns."""
    rest = [c for c in docs.columns if c not in (id_col, host_col, text_col)]
    judged = judge(docs, id_col, host_col, text_col, with_text=True).where("kept")
    held = {id_col: "doc_id", host_col: "_host", text_col: "_text"} | {c: f"_c{k}" for k, c in enumerate(rest)}
    return judged.select(*(F.col(held[c]).cast(kind).alias(c) for c, kind in docs.dtypes))


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
