"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a slice of texts (a run of blanks with what follows it) are laid in a row and indexed by a suffix
array.  Every piece of the model is searched in it by bisection; its range of suffixes are its occurrences.  These
edges, sorted by position, are then relaxed: for a BPE model, in order of the pieces' scores, the best edge over two
neighbouring symbols first, as merging does; the models at hand are of that type, so that the additive
relaxation of unigram models is not built.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids_frame, offsets_of, slices, small_batches, strings, sums_by, table

#: The model's mark for a blank.
BLANK = "▁"
#: Chunks up to this many characters are relaxed side by side, longer ones with a heap each.
SHORT_CHUNK = 64
#: Characters of chunks that are indexed at a time, and encoded chunks that a Python worker keeps.
INDEXED_CHARACTERS = 600_000
KEPT_CHUNKS = 300_000


class Pieces:
    """The pieces of a BPE model with byte fallback, with what encoding and decoding need."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.vocab_size()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(count)]
        byte = [model.is_byte(i) for i in range(count)]
        text = [model.id_to_piece(i) for i in range(count)]
        self.bytes = [b"" if special[i] else bytes([int(text[i][3:5], 16)]) if byte[i] else text[i].replace(BLANK, " ").encode() for i in range(count)]
        self.of_byte = np.array([next(i for i in range(count) if byte[i] and self.bytes[i][0] == b) for b in range(256)], np.uint32)
        self.score = np.array([model.get_score(i) for i in range(count)], np.float64)
        own = [i for i in range(count) if not special[i] and not byte[i]]
        if any(self.score[i] != int(self.score[i]) for i in own):
            raise ValueError("scores that are no ranks of merges: this is not a BPE model")
        self.ids = np.array(own, np.int64)
        self.length = np.array([len(text[i]) for i in own], np.int64)
        self.longest = int(self.length.max())
        self.points = np.zeros((len(own), self.longest), np.int64)
        for k, i in enumerate(own):
            self.points[k, : len(text[i])] = [ord(c) for c in text[i]]
        joined = "\0".join(text[i] for i in own)
        if re.search(f"[^\0{BLANK}]{BLANK}", joined) or "\n" in joined:
            raise ValueError("a piece of this model reaches over a blank or holds a line feed; chunks would cut it")


@functools.lru_cache(maxsize=2)
def _loaded(path: str) -> tuple[Pieces, dict]:
    return Pieces(path), {}


def suffix_array(points: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the text from there on, as far as the first `depth` characters, by doubling of ranks."""
    rank = np.unique(points, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)[1]
        step *= 2
    return np.argsort(rank, kind="stable")


def _bisect(text: np.ndarray, order: np.ndarray, pieces: Pieces, after: bool) -> np.ndarray:
    """For every piece, the number of suffixes before it (or, with `after`, before it or beginning with it)."""
    low, high = np.zeros(len(pieces.ids), np.int64), np.full(len(pieces.ids), len(order), np.int64)
    columns = np.arange(pieces.longest)
    within = columns < pieces.length[:, None]
    while (open_ := low < high).any():
        some = np.flatnonzero(open_)
        middle = (low[some] + high[some]) // 2
        found = text[order[middle][:, None] + columns]
        differ = (found != pieces.points[some]) & within[some]
        first = differ.argmax(axis=1)
        rows = np.arange(len(some))
        less = np.where(differ[rows, first], found[rows, first] < pieces.points[some][rows, first], after)
        low[some] = np.where(less, middle + 1, low[some])
        high[some] = np.where(less, high[some], middle)
    return low


def edges_of(chunks: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the chunks with a mark after each, begins of chunks, and the piece at (position, length), -1 for none."""
    text = np.frombuffer(("\0".join(chunks) + "\0").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
    order = suffix_array(text, pieces.longest)
    padded = np.concatenate((text, np.full(pieces.longest, -1)))
    first, end = _bisect(padded, order, pieces, False), _bisect(padded, order, pieces, True)
    times = end - first
    piece = np.repeat(np.arange(len(times)), times)
    place = order[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]
    by_place = np.argsort(place, kind="stable")
    piece, place = piece[by_place], place[by_place]
    edge = np.full((len(text), pieces.longest + 1), -1, np.int32)
    edge[place, pieces.length[piece]] = pieces.ids[piece]
    return text, offsets_of(sizes + 1), edge


def _relax_long(begin: int, end: int, edge: np.ndarray, score: np.ndarray) -> list[int]:
    """Lengths of the symbols of one chunk."""
    after, before, size = {i: i + 1 for i in range(begin, end)}, {i: i - 1 for i in range(begin, end)}, dict.fromkeys(range(begin, end), 1)
    heap: list[tuple] = []

    def offer(a: int) -> None:
        b = after[a]
        if b < end and (n := size[a] + size[b]) < edge.shape[1] and (k := edge[a, n]) >= 0:
            heapq.heappush(heap, (-score[k], a, size[a], size[b]))

    for i in range(begin, end):
        offer(i)
    while heap:
        _, a, left, right = heapq.heappop(heap)
        if size.get(a) != left or (b := after[a]) >= end or size[b] != right:
            continue
        size[a] += size.pop(b)
        after[a] = after.pop(b)
        if after[a] < end:
            before[after[a]] = a
        offer(a)
        if before[a] >= begin:
            offer(before[a])
    return [size[i] for i in sorted(size)]


def encode_chunks(chunks: list[str], pieces: Pieces) -> list[bytes]:
    """The ids of each chunk as little-endian unsigned 32-bit integers."""
    text, begin, edge = edges_of(chunks, pieces)
    longest = edge.shape[1] - 1
    sizes = np.diff(begin) - 1
    short = np.flatnonzero((sizes <= SHORT_CHUNK) & (sizes > 0))
    # Symbols of all short chunks: begin and length; in each round every chunk takes its best edge over two symbols.
    chunk = np.repeat(short, sizes[short])
    place = begin[chunk] + np.arange(len(chunk)) - np.repeat(offsets_of(sizes[short])[:-1], sizes[short])
    length = np.ones(len(place), np.int64)
    done_place, done_length = [], []
    while len(place):
        joined = np.zeros(len(place), np.int64)
        joined[:-1] = length[:-1] + length[1:]
        pair = np.zeros(len(place), bool)
        pair[:-1] = chunk[:-1] == chunk[1:]
        found = np.where(pair & (joined <= longest), edge[place, np.minimum(joined, longest)], -1)
        score = np.where(found >= 0, pieces.score[found], -np.inf)
        starts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
        best = np.maximum.reduceat(score, starts)
        counts = np.diff(np.append(starts, len(chunk)))
        settled = np.repeat(np.isinf(best), counts)
        done_place.append(place[settled])
        done_length.append(length[settled])
        at = np.flatnonzero((score == np.repeat(best, counts)) & ~settled)
        at = at[np.concatenate(([True], chunk[at][1:] != chunk[at][:-1]))] if len(at) else at
        length[at] = joined[at]
        settled[at + 1] = True
        place, length, chunk = place[~settled], length[~settled], chunk[~settled]
    for i in np.flatnonzero(sizes > SHORT_CHUNK):
        lengths = np.array(_relax_long(int(begin[i]), int(begin[i + 1]) - 1, edge, pieces.score))
        done_place.append(begin[i] + offsets_of(lengths)[:-1])
        done_length.append(lengths)
    place, length = np.concatenate([*done_place, np.zeros(0, np.int64)]), np.concatenate([*done_length, np.zeros(0, np.int64)])
    order = np.argsort(place, kind="stable")
    place, length = place[order], length[order]
    ids = edge[place, length].astype(np.int64)
    edges = np.searchsorted(place, begin)
    out = []
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):  # characters without a piece become their bytes
        raw = {int(i): pieces.of_byte[np.frombuffer(chr(text[place[i]]).encode("utf-8", "surrogatepass"), np.uint8)] for i in unknown}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            parts = [raw[i] if i in raw else ids[i : i + 1].astype(np.uint32) for i in range(a, b)]
            out.append(ids_frame(np.concatenate(parts)) if parts else b"")
        return out
    frame = ids_frame(ids.astype(np.uint32))
    return [frame[4 * a : 4 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def independent_parts(chunk: str, pieces: Pieces, step: int = INDEXED_CHARACTERS) -> list[str]:
    """A long chunk, cut wherever no occurrence of a piece reaches over: no merge can either.

    Occurrences are looked up in overlapping stretches, so that only a mark for each character is held.
    """
    crossed = np.zeros(len(chunk), bool)
    for begin in range(0, len(chunk), step):
        text = chunk[begin : begin + step + pieces.longest]
        _, _, edge = edges_of([text], pieces)
        change = np.zeros(len(text) + 2, np.int64)
        place, length = np.nonzero(edge[: min(step, len(text)), 2:] >= 0)
        np.add.at(change, place, 1)
        np.add.at(change, np.minimum(place + length + 1, len(text)), -1)
        crossed[begin : begin + len(text)] |= np.cumsum(change)[: len(text)] > 0
    cuts = [0, *(np.flatnonzero(~crossed) + 1).tolist()]
    if cuts[-1] != len(chunk):
        cuts.append(len(chunk))
    return [chunk[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_CHUNK = re.compile(f"\n|{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+")


def chunks_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of texts in a row, and their number in each; an empty text has none."""
    odd = pc.match_substring_regex(texts, f"^ |  | $|[\\x00{BLANK}]| \\n").to_numpy(zero_copy_only=False)
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    plain = pa.array(~odd & ~empty)
    marked = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.filter(plain), pa.scalar("", pa.large_string()))
    marked = pc.replace_substring(pc.replace_substring(marked, " ", f"\0{BLANK}"), "\n", "\0\n\0")
    cut = pc.split_pattern(marked, "\0")
    counts = np.zeros(len(texts), np.int64)
    counts[np.flatnonzero(~odd & ~empty)] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    if not odd.any():
        return cut.flatten(), counts
    flat, begin = cut.flatten(), offsets_of(counts[~odd & ~empty])
    parts, at = [], 0
    for i, text in enumerate(texts):
        if odd[i]:
            found = _CHUNK.findall(BLANK + text.as_py().replace(" ", BLANK))
            counts[i] = len(found)
            parts.append(pa.array(found, pa.large_string()))
        elif not empty[i]:
            parts.append(flat.slice(begin[at], begin[at + 1] - begin[at]))
            at += 1
    return pa.chunked_array(parts, pa.large_string()).combine_chunks(), counts


def _encode_parts(chunks: list[str], pieces: Pieces) -> list[bytes]:
    """The ids of each chunk; a chunk that is too long to be indexed at once goes by its independent parts."""
    if max(map(len, chunks)) <= INDEXED_CHARACTERS:
        return encode_chunks(chunks, pieces)
    out = []
    for chunk in chunks:
        parts, ids, at = independent_parts(chunk, pieces) if len(chunk) > INDEXED_CHARACTERS else [chunk], [], 0
        while at < len(parts):
            size, n = 0, 0
            while at + n < len(parts) and (n == 0 or size < INDEXED_CHARACTERS):
                size += len(parts[at + n]) + 1
                n += 1
            ids += encode_chunks(parts[at : at + n], pieces)
            at += n
        out.append(b"".join(ids))
    return out


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts in a row, and the offsets at which each text's ids begin."""
    pieces, kept = _loaded(path)
    flat, counts = chunks_of(strings(texts))
    if not len(flat):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    coded = flat.dictionary_encode()
    codes, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    found = [kept.get(x) for x in distinct]
    missing = [i for i, x in enumerate(found) if x is None]
    while missing:
        size, n = 0, 0
        while n < len(missing) and (n == 0 or size < INDEXED_CHARACTERS):
            size += len(distinct[missing[n]]) + 1
            n += 1
        some, missing = missing[:n], missing[n:]
        # A mark of ours inside a chunk would cut it: such chunks are encoded by their parts.
        parts = [distinct[i].split("\0") for i in some]
        got = _encode_parts([y for x in parts for y in x], pieces)
        zero, at = ids_frame(pieces.of_byte[:1]), 0
        for i, x in zip(some, parts, strict=True):
            found[i] = ids = zero.join(got[at : at + len(x)])
            at += len(x)
            if len(kept) < KEPT_CHUNKS and len(distinct[i]) <= SHORT_CHUNK:
                kept[distinct[i]] = ids
    every = np.frombuffer(b"".join(found), "<u4")
    lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
    begins, sizes = offsets_of(lengths)[codes], lengths[codes]
    ends = np.cumsum(sizes)
    ids = every[np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1])]
    return ids, offsets_of(sums_by(sizes, offsets_of(counts)))


def decode(ids: np.ndarray, path: str) -> str:
    """The text of ids: pieces and bytes in a row without the blank that encoding put first; bad bytes become U+FFFD."""
    pieces, _ = _loaded(path)
    data = b"".join([pieces.bytes[i] for i in ids.tolist()])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256 (of the ids decoded again), round_trip and, if asked for, the ids.

    Null texts are empty and have no pieces.  Ids may be null or repeat; other columns are ignored.  Very long runs without
    a blank are cut where no piece reaches over; only a run without such a place, as of one letter, is held whole.
    """
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            texts = strings(batch.column(1))
            ids, offsets = encode(texts, path)
            own = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            back = [decode(x, path) for x in own]
            out = {
                "doc_id": batch.column(0),
                "n_pieces": pa.array(np.diff(offsets)),
                "ids_crc32": pa.array([zlib.crc32(ids_frame(x)) for x in own], pa.int64()),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in back], pa.string()),
                "round_trip": pc.equal(pa.array(back, pa.large_string()), texts),
            }
            if with_ids:
                out["ids"] = pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<long>" * with_ids)


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
