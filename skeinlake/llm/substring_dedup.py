"""Removal of repeated passages, by fixed-block anchors.

Texts are written once, as numbered words in slices of some megabytes, to the shared folder; everything after that moves
hashes and positions.  Non-overlapping blocks of each document are indexed and probed with every rolling
window of a block's length: as a passage of twice a block's length holds a whole block, a passage that occurs
elsewhere has a hit.  Hits are extended over the windows of the passage length that hold them; for each window, the earliest place
of an equal one is found by its hash, and windows in a row with places in a row make a maximal repeat.

The words of each maximal repeat are then held against the words of its earlier place.  Where they differ, two texts
share a hash: windows of such hashes are told apart by their words.

A slice sends each different hash once, however often it holds it, so that no passage makes a large group; cells of several
slices that are stored together travel as one row.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import codes_of, hashes_of, offsets_of, slices, small_batches, stage, strings, table, words_of, work_path

WINDOW_WORDS = 20
#: Hashes that one task compares.
TASK_HASHES = 2_000_000
#: Bytes of text of a slice, which tasks work on at once, and slices that are stored, sent and answered together.
SLICE_BYTES = 4 << 20
CHUNK_SLICES = 8
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CELLS = "part int, name string, chunk int, data binary"
_STORED = pa.schema([("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32())), ("words", pa.list_(pa.large_string()))])


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` word hashes."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = out * _FACTOR + words[k : k + len(out)]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(32))


def pack_positions(positions: np.ndarray, kind: type) -> bytes:
    """Ascending positions as differences; one that is too large is a run of the largest number."""
    most = np.iinfo(kind).max
    steps = np.diff(positions, prepend=0)
    ends = np.cumsum(steps // most + 1)
    out = np.full(ends[-1] if len(ends) else 0, most, kind)
    out[ends - 1] = steps % most
    return out.tobytes()


def unpack_positions(data: bytes, kind: type) -> np.ndarray:
    steps = np.frombuffer(data, kind)
    return np.cumsum(steps, dtype=np.int64)[steps != np.iinfo(kind).max]


def _kind(parts: int) -> type:
    return np.uint8 if parts < 128 else np.uint16


def _record(number: int, *blobs: bytes) -> bytes:
    """The blobs of a slice with their sizes, for a row that holds several slices'."""
    return np.array([number, *(len(b) for b in blobs)], "<u4").tobytes() + b"".join(blobs)


def _records(data: bytes, n: int) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(data):
        head = np.frombuffer(data, "<u4", n + 1, at).astype(np.int64)
        ends = at + 4 * (n + 1) + offsets_of(head[1:])
        yield int(head[0]), [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        at = int(ends[-1])


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class _Slice:
    """A stored slice: document ids, words by number, and where windows of `width` words may begin.

    `keep` is the number of bits that hashes of windows of the passage length have.
    """

    def __init__(self, reader: pa.ipc.RecordBatchFileReader, number: int, keep: int = 64):
        batch = reader.get_batch(number)
        self.number, self.mask = number, np.uint64(2**64 - 2 ** (64 - keep))
        self.doc_ids, counts, self.codes, self.words = (batch.column(k)[0].values for k in range(4))
        self.offsets = offsets_of(counts.to_numpy())
        self.codes = self.codes.to_numpy()
        self.hashes = hashes_of(self.words)[self.codes] if len(self.codes) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))

    def _inside(self, found: np.ndarray, width: int) -> np.ndarray:
        return np.flatnonzero(self.offsets[1:][self.doc[: len(found)]] - np.arange(len(found)) >= width)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows inside documents, and their positions."""
        found = rolling(self.hashes, width)
        at = self._inside(found, width)
        return found[at], at

    def candidates(self, live: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and positions of the windows that hold a block that was hit; `live` has one position of each hit hash."""
        every = rolling(self.hashes, block)
        at = self._inside(every, block)
        hit = np.zeros(len(self.hashes) + 1, np.int64)
        hit[1:][at[np.isin(every[at], every[live])]] = 1
        hit = np.cumsum(hit)
        hashes, at = self.windows(window)
        chosen = hit[at + window - block + 1] > hit[at]
        return hashes[chosen] & self.mask, at[chosen]

    def order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document its id (null before all), a hash of its words, and its rank by both."""
        ids = self.doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        place = np.arange(len(self.hashes)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, _FACTOR))
        total = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * powers[place], out=total[1:])
        mixed = total[self.offsets[1:]] - total[self.offsets[:-1]]
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((mixed, ids))] = np.arange(len(ids))
        return ids, mixed, rank

    def first_of_each(self, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of each hash's first window in order of (document, position), and for each window the index of the first."""
        rank = self.order()[2][self.doc[at]]
        order = np.lexsort((at, rank, hashes))
        starts = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])) if len(order) else np.zeros(0, bool)
        first = np.empty(len(order), np.int64)
        first[order] = order[starts][np.cumsum(starts) - 1] if len(order) else order
        return order[starts], first

    def differs(self, at: np.ndarray, other: np.ndarray, window: int) -> np.ndarray:
        """Whether the words of windows at two positions differ."""
        out = np.zeros(len(at), bool)
        for k in range(window):
            out |= self.codes[at + k] != self.codes[other + k]
        return out

    def text(self, begin: int, end: int) -> str:
        return " ".join(self.words.take(pa.array(self.codes[begin:end])).to_pylist())


def _open(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    return pa.ipc.open_file(files.open_file(f"{folder}/{name}"))


def store(docs: DataFrame, folder: str, id_col: str, text_col: str) -> DataFrame:
    """Writes the words of the texts in slices; a row for each chunk of slices: its place and its number of words."""
    small_batches(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, writer, sizes = "", None, None, []
        for batch in slices(batches, SLICE_BYTES):
            words, offsets = words_of(strings(batch.column(1)))
            codes, distinct = codes_of(words)
            record = [batch.column(0).to_pylist(), np.diff(offsets), codes.astype(np.int32), distinct.cast(pa.large_string())]
            if writer is None:
                path, out = files.create(folder, ".arrow")
                name = path.rsplit("/", 1)[1]
                writer = pa.ipc.new_file(out, _STORED, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            columns = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind.type.value_type)) for x, kind in zip(record, _STORED, strict=True)]
            writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=_STORED))
            sizes.append(len(words))
        if writer is not None:
            writer.close()
            out.close()
            firsts = list(range(0, len(sizes), CHUNK_SLICES))
            n = [len(sizes[f : f + CHUNK_SLICES]) for f in firsts]
            yield pa.RecordBatch.from_pydict({"name": [name] * len(n), "chunk": pa.array(firsts, pa.int32()), "n": pa.array(n, pa.int32()), "words": pa.array([sum(sizes[f : f + CHUNK_SLICES]) for f in firsts], pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(rows.mapInArrow(task, "name string, chunk int, n int, words long"), "slices")


def _cells(cells: dict[int, list[bytes]], name: str, chunk: int) -> pa.RecordBatch:
    data = [b"".join(cells[p]) for p in cells]
    return pa.RecordBatch.from_pydict({"part": pa.array(list(cells), pa.int32()), "name": pa.array([name] * len(cells), pa.string()), "chunk": pa.array([chunk] * len(cells), pa.int32()), "data": pa.array(data, pa.binary())})


def find_hits(places: DataFrame, folder: str, block: int, parts: int) -> DataFrame:
    """Probes the indexed blocks with all rolling windows; for each slice, one position of each hash that was hit."""
    kind = _kind(parts)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, chunk, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                reader, cells = _open(folder, name), defaultdict(list)
                for number in range(chunk, chunk + n):
                    held = _Slice(reader, number)
                    hashes, at = held.windows(block)
                    distinct, first, codes, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                    anchors = np.zeros(len(distinct), bool)
                    anchors[codes[(at - held.offsets[held.doc[at]]) % block == 0]] = True
                    position, part = at[first], _parts_of(distinct, parts)
                    # Runs of one part: by whether the hash is indexed and whether it repeats here, then by position.
                    sort = 2 * anchors + (count > 1)
                    order = np.lexsort((position, sort, part))
                    key = (part * 4 + sort)[order]
                    edges = np.searchsorted(key, np.arange(4 * parts + 1))
                    low = distinct[order].astype("<u4")
                    for p in np.unique(part).tolist():
                        cut = edges[4 * p : 4 * p + 5]
                        runs = [(low[a:b].tobytes(), pack_positions(position[order[a:b]], kind)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                        cells[p].append(_record(number, *(x for run in runs for x in run)))
                yield _cells(cells, name, chunk)

    def compare(group: pa.Table) -> pa.Table:
        low, unit, sort, place, units = [], [], [], [], []
        for i, data in enumerate(group.column("data")):
            for number, blobs in _records(data.as_py(), 8):
                for k in range(4):
                    low.append(np.frombuffer(blobs[2 * k], "<u4"))
                    place.append(unpack_positions(blobs[2 * k + 1], kind))
                    unit.append(np.full(len(low[-1]), len(units)))
                    sort.append(np.full(len(low[-1]), k, np.int8))
                units.append((i, number))
        low, unit, sort, place = map(np.concatenate, (low, unit, sort, place))
        _, codes, count = np.unique(low, return_inverse=True, return_counts=True)
        anchored, again = np.zeros(len(count), bool), count > 1
        anchored[codes[sort >= 2]] = True
        again[codes[sort % 2 == 1]] = True
        live = np.flatnonzero((anchored & again)[codes])
        live = live[np.lexsort((place[live], unit[live]))]
        edges = np.searchsorted(unit[live], np.arange(len(units) + 1))
        answers = defaultdict(list)
        for u in np.flatnonzero(np.diff(edges)).tolist():
            i, number = units[u]
            answers[i].append(_record(number, pack_positions(place[live[edges[u] : edges[u + 1]]], np.uint16)))
        rows = pa.array(list(answers), pa.int64())
        return pa.table({"name": group.column("name").take(rows), "chunk": group.column("chunk").take(rows), "data": pa.array([b"".join(x) for x in answers.values()], pa.binary())})

    cells = places.select("name", "chunk", "n").mapInArrow(probe, _CELLS)
    return stage(cells.repartition(2 * parts, "part").groupBy("part").applyInArrow(compare, "name string, chunk int, data binary"), "hits")


def _live(data: list[bytes]) -> dict[int, np.ndarray]:
    """Hit positions by slice."""
    out = defaultdict(list)
    for some in data:
        for number, (packed,) in _records(some, 1):
            out[number].append(unpack_positions(packed, np.uint16))
    return {number: np.concatenate(x) for number, x in sorted(out.items())}


#: A part that no hash has: hashes of windows of a slice that are equal though their words differ.
_COLLIDED = -1


def find_repeats(hits: DataFrame, folder: str, block: int, window: int, parts: int, slots: int, keep: int) -> tuple[DataFrame, DataFrame]:
    """Compares the windows around hits: for each chunk, the first windows that occur earlier in another slice, and where; and collided hashes."""
    kind = _kind(parts)

    def send(group: pa.Table) -> pa.Table:
        name, chunk = group.column("name")[0].as_py(), group.column("chunk")[0].as_py()
        reader, cells = _open(folder, name), defaultdict(list)
        for number, live in _live(group.column("data").to_pylist()).items():
            held = _Slice(reader, number, keep)
            hashes, at = held.candidates(live, block, window)
            first, of_each = held.first_of_each(hashes, at)
            if (bad := np.unique(hashes[held.differs(at, at[of_each], window)])).size:
                cells[_COLLIDED].append(bad.astype("<u8").tobytes())
            hashes, at = hashes[first], at[first]
            part = _parts_of(hashes, parts)
            order = np.lexsort((at, part))
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            ids, mixed, _ = held.order()
            for p in np.unique(part).tolist():
                chosen = order[edges[p] : edges[p + 1]]
                docs, runs = np.unique(held.doc[at[chosen]], return_counts=True)
                cells[p].append(_record(number, hashes[chosen].astype("<u8").tobytes(), pack_positions(at[chosen], kind), ids[docs].astype("<i8").tobytes(), mixed[docs].astype("<u8").tobytes(), runs.astype("<u4").tobytes()))
        return pa.Table.from_batches([_cells(cells, name, chunk)])

    def compare(group: pa.Table) -> pa.Table:
        hashes, ids, mixed, unit, place, units = [], [], [], [], [], []
        names = [f"{n} {c:09d}" for n, c in zip(group.column("name").to_pylist(), group.column("chunk").to_pylist(), strict=True)]
        for i in sorted(range(len(names)), key=names.__getitem__):
            for number, (h, at, docs, mix, runs) in _records(group.column("data")[i].as_py(), 5):
                runs = np.frombuffer(runs, "<u4")
                hashes.append(np.frombuffer(h, "<u8"))
                place.append(unpack_positions(at, kind))
                ids.append(np.repeat(np.frombuffer(docs, "<i8"), runs))
                mixed.append(np.repeat(np.frombuffer(mix, "<u8"), runs))
                unit.append(np.full(len(hashes[-1]), len(units)))
                units.append((i, number))
        hashes, ids, mixed, unit, place = map(np.concatenate, (hashes, ids, mixed, unit, place))
        order = np.lexsort((unit, mixed, ids, hashes))
        same = np.concatenate(([False], hashes[order][1:] == hashes[order][:-1]))
        source = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later, source = order[same], source[same]
        sort = np.lexsort((place[later], unit[later]))
        later, source = later[sort], source[sort]
        edges = np.searchsorted(unit[later], np.arange(len(units) + 1))
        answers, sources = defaultdict(list), {}
        for u in np.flatnonzero(np.diff(edges)).tolist():
            i, number = units[u]
            a, b = edges[u], edges[u + 1]
            known = sources.setdefault(i, {})
            own = np.array([known.setdefault(s, len(known)) for s in np.unique(unit[source[a:b]]).tolist()], "<u4")
            own = own[np.unique(unit[source[a:b]], return_inverse=True)[1]]
            answers[i].append(_record(number, pack_positions(place[later[a:b]], np.uint16), own.tobytes(), place[source[a:b]].astype("<u4").tobytes()))
        rows = list(answers)
        table_of = [[f"{group.column('name')[units[s][0]].as_py()} {units[s][1]}" for s in sources[i]] for i in rows]
        at = pa.array(rows, pa.int64())
        return pa.table({"name": group.column("name").take(at), "chunk": group.column("chunk").take(at), "data": pa.array([b"".join(answers[i]) for i in rows], pa.binary()), "sources": pa.array(table_of, pa.list_(pa.string()))})

    cells = stage(hits.repartition(2 * slots, "name", "chunk").groupBy("name", "chunk").applyInArrow(send, _CELLS), "cells")
    again = cells.where(F.col("part") >= 0).repartition(2 * parts, "part").groupBy("part").applyInArrow(compare, "name string, chunk int, data binary, sources array<string>")
    return stage(again, "repeats"), cells.where(F.col("part") == _COLLIDED).select("data")


def _later(data: list[bytes], sources: list[list[str]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """By slice: positions of later windows, ascending, the numbers of their sources, positions there, and the sources."""
    known: dict[str, int] = {}
    found = defaultdict(list)
    for some, names in zip(data, sources, strict=True):
        number_of = np.array([known.setdefault(s, len(known)) for s in names], np.int64)
        for number, (at, own, there) in _records(some, 3):
            found[number].append((unpack_positions(at, np.uint16), number_of[np.frombuffer(own, "<u4")], np.frombuffer(there, "<u4").astype(np.int64)))
    out = {}
    for number, parts in sorted(found.items()):
        at, own, there = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(at)
        out[number] = at[order], own[order], there[order], list(known)
    return out


def verify(again: DataFrame, folder: str, window: int, slots: int, keep: int) -> DataFrame:
    """Holds the words of each maximal repeat against those of its earlier place; the hashes of windows that differ."""

    def ask(group: pa.Table) -> pa.Table:
        name, rows = group.column("name")[0].as_py(), []
        reader = _open(folder, name)
        for number, (at, own, there, sources) in _later(group.column("data").to_pylist(), group.column("sources").to_pylist()).items():
            held = _Slice(reader, number, keep)
            # Windows in a row with sources in a row: one repeat, whose words travel once.
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (np.diff(there) != 1) | (np.diff(own) != 0)
            begins = np.flatnonzero(new)
            for a, b in zip(begins.tolist(), np.append(begins[1:], len(at)).tolist(), strict=True):
                source, slice_there = sources[own[a]].rsplit(" ", 1)
                rows.append((source, int(slice_there), int(there[a]), held.text(int(at[a]), int(at[b - 1]) + window)))
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("name", pa.string()), ("slice", pa.int32()), ("at", pa.int64()), ("words", pa.string())))})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_name, reader, last = None, None, None, ""
        for batch in batches:
            bad = set()
            for name, number, at, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != open_name:
                    open_name, reader, held = name, _open(folder, name), None
                if held is None or held.number != number:
                    held, last = _Slice(reader, number, keep), None
                asked = words.split(" ")
                if last != (at, len(asked)):
                    text, last = held.text(at, at + len(asked)), (at, len(asked))
                if text != words:
                    own = text.split(" ")
                    hashes = rolling(held.hashes[at : at + len(asked)], window) & held.mask
                    bad.update(int(hashes[i]) for i in range(len(hashes)) if own[i : i + window] != asked[i : i + window])
            yield pa.RecordBatch.from_pydict({"data": pa.array([np.array(sorted(bad), "<u8").tobytes()] if bad else [], pa.binary())})

    rows = again.repartition(2 * slots, "name", "chunk").groupBy("name", "chunk").applyInArrow(ask, "name string, slice int, at long, words string")
    # By ranges, so that a passage that many documents have is looked up by many tasks.
    rows = stage(rows, "repeated-words").repartitionByRange(slots, "name", "slice", "at", F.xxhash64("words")).sortWithinPartitions("name", "slice", "at", "words")
    return stage(rows.mapInArrow(answer, "data binary"), "collisions")


def tell_apart(hits: DataFrame, folder: str, block: int, window: int, slots: int, keep: int, collided: np.ndarray) -> DataFrame:
    """The windows of collided hashes that have an earlier equal one, by their words: name, chunk, slice, at."""
    sent = hits.sparkSession.sparkContext.broadcast(collided)  # pairs of texts that share a hash: hardly ever one

    def task(group: pa.Table) -> pa.Table:
        name, chunk = group.column("name")[0].as_py(), group.column("chunk")[0].as_py()
        reader, rows = _open(folder, name), []
        for number, live in _live(group.column("data").to_pylist()).items():
            held = _Slice(reader, number, keep)
            hashes, at = held.candidates(live, block, window)
            ids, mixed, _ = held.order()
            for i in np.flatnonzero(np.isin(hashes, sent.value)).tolist():
                d = int(held.doc[at[i]])
                rows.append((held.text(int(at[i]), int(at[i]) + window), int(ids[d]), int(mixed[d].view(np.int64)), name, chunk, number, int(at[i])))
        kinds = (("words", pa.string()), ("id", pa.int64()), ("mixed", pa.int64()), ("name", pa.string()), ("chunk", pa.int32()), ("slice", pa.int32()), ("at", pa.int64()))
        return pa.table({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate(kinds)})

    rows = hits.repartition(2 * slots, "name", "chunk").groupBy("name", "chunk").applyInArrow(task, "words string, id long, mixed long, name string, chunk int, slice int, at long")
    rows = stage(rows, "collided-windows")
    place = F.struct("id", "mixed", "name", "slice", "at")
    firsts = rows.groupBy("words").agg(F.min(place).alias("first"))
    return stage(rows.join(firsts, "words").where(place != F.col("first")).select("name", "chunk", "slice", "at"), "later-windows")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS, with_text: bool = False, keep: int = 64) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept words as `kept_text`.

    A word goes if a window that covers it has an equal one with an earlier start: in a document of
    smaller id, or in the same document.  Null ids come before all others; rows with the same id are ordered by a hash of
    their words.  Null texts have no words; texts of fewer words than a window stay as they are.  Other columns are
    ignored, and an empty table gives no row.  `keep` is the number of bits of window hashes; with few, more windows are told apart by their words.
    """
    spark, block = docs.sparkSession, window // 2
    folder = work_path(spark, "text-slices")
    places = store(docs, folder, id_col, text_col)
    total = places.agg(F.sum("words")).first()[0] or 0
    slots = max(1, min(places.count(), 20_000))
    parts = total // TASK_HASHES + 1
    hits = find_hits(places.repartition(slots), folder, block, parts)
    again, local = find_repeats(hits, folder, block, window, parts // 2 + 1, slots, keep)
    bad = [np.frombuffer(r["data"], "<u8") for r in local.unionByName(verify(again, folder, window, slots, keep)).collect()]  # of collided hashes alone
    collided = np.unique(np.concatenate(bad)) if bad else np.zeros(0, np.uint64)
    apart = tell_apart(hits, folder, block, window, slots, keep, collided) if len(collided) else None

    def finish(group: pa.Table) -> pa.Table:
        name, chunk = group.column("name")[0].as_py(), group.column("chunk")[0].as_py()
        by_sort = defaultdict(list)
        for row in group.select(["sort", "data", "n", "sources", "slice", "at"]).to_pylist():
            by_sort[row["sort"]].append(row)
        live = _live([r["data"] for r in by_sort[1]])
        later = _later([r["data"] for r in by_sort[2]], [r["sources"] for r in by_sort[2]])
        known = defaultdict(list)
        for row in by_sort[3]:
            known[row["slice"]].append(row["at"])
        reader, tables = _open(folder, name), []
        for number in range(chunk, chunk + by_sort[0][0]["n"]):
            held = _Slice(reader, number, keep)
            cover = np.zeros(len(held.hashes) + 1, np.int64)
            if number in live:
                hashes, at = held.candidates(live[number], block, window)
                first, _ = held.first_of_each(hashes, at)
                repeated = np.ones(len(at), bool)
                repeated[first] = np.isin(at[first], later[number][0]) if number in later else False
                if len(collided):
                    repeated = np.where(np.isin(hashes, collided), np.isin(at, known[number]), repeated)
                np.add.at(cover, at[repeated], 1)
                np.add.at(cover, at[repeated] + window, -1)
            stays = np.cumsum(cover)[:-1] <= 0
            counts = np.add.reduceat(np.append(stays, False).astype(np.int64), held.offsets[:-1]) if len(held.offsets) > 1 else np.zeros(0, np.int64)
            counts[np.diff(held.offsets) == 0] = 0
            kept = pa.ListArray.from_arrays(pa.array(offsets_of(counts), pa.int32()), held.words.cast(pa.string()).take(pa.array(held.codes[stays])))
            kept = pc.binary_join(kept, " ")
            out = {
                "doc_id": held.doc_ids,
                "n_words": pa.array(np.diff(held.offsets)),
                "n_removed": pa.array(np.diff(held.offsets) - counts),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept.cast(pa.binary()).to_pylist()], pa.string()),
            }
            tables.append(pa.table(out | ({"kept_text": kept} if with_text else {})))
        return pa.concat_tables(tables)

    nothing = {"n": F.lit(0), "data": F.lit(b""), "sources": F.lit(None).cast("array<string>"), "slice": F.lit(0), "at": F.lit(0).cast("long")}
    rows = []
    for k, some in enumerate((places, hits, again, apart)):
        if some is not None:
            rows.append(some.select("name", "chunk", F.lit(k).alias("sort"), *(F.col(c) if c in some.columns else e.alias(c) for c, e in nothing.items())))
    every = rows[0]
    for other in rows[1:]:
        every = every.unionByName(other)
    # The rows are small, but each chunk's work is not: their number of tasks is not left to their size.
    return every.repartition(2 * slots, "name", "chunk").groupBy("name", "chunk").applyInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
