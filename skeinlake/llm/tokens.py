"""Token ids of whole texts with the public tokenizers, over columns of texts.

A tokenizer cuts a text at its added tokens, then into pre-tokens, before it merges; so a text's ids are the ids of
its pieces in a row as long as pieces end where pre-tokens do.  Pieces repeat far more often than texts do:
each distinct piece of a slice is encoded once, and pieces that a slice repeats are kept for later slices.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import offsets_of, strings, sums_by, words_of

#: Kept pieces of a Python worker; pieces beyond it are encoded anew in each slice.
KEPT_PIECES = 250_000
#: Pieces that are encoded as one text.
JOINED = 256
#: Longer pieces are not kept.
KEPT_LENGTH = 40
#: White space other than ASCII's, and the mark that `_byte_pieces` cuts at.
_ODD = "[\\x00\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_RUNS = "[\\t-\\r ][\\t-\\r ]|[\\t\\x0b\\x0c\\r]"
#: Pieces of these characters alone (and one blank in front) may be joined: none is white space, and none changes its number of bytes in lower case or NFC.
_JOINS = "^ ?[!-~\\x{a1}-\\x{12f}\\x{131}-\\x{239}\\x{23b}-\\x{23d}\\x{23f}-\\x{2ff}\\x{370}-\\x{373}\\x{388}-\\x{3ff}\\x{400}-\\x{52f}\\x{620}-\\x{64a}\\x{3041}-\\x{3096}\\x{30a1}-\\x{30fa}\\x{4e00}-\\x{9fff}\\x{ac00}-\\x{d7a3}]+$"
_PIECE = re.compile("(?: ?[^ \\t-\\r]+|[ \\t-\\r]+(?![^ \\t-\\r])|[ \\t-\\r]+)")


class _Loaded:
    """A tokenizer, the bytes that each of its ids stands for, its added tokens, and the pieces kept so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Byte-level pieces have a character for each byte.
        vocabulary = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token.removesuffix("</w>"))
        self.drops_space = self.tokenizer.normalizer is not None
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {str(t.content): number for number, t in added.items()}
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError(f"{path} has added tokens that do not match exactly as they are written")
        self.pattern = "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))
        self.kept, self.ids, self.offsets = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, pieces: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> None:
        self.kept = pa.concat_arrays([self.kept, pieces])
        self.ids = np.concatenate((self.ids, ids))
        self.offsets = np.concatenate((self.offsets, self.offsets[-1] + offsets[1:]))


_loaded = functools.lru_cache(maxsize=4)(_Loaded)


def _by_word(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces for tokenizers that drop white space: its words."""
    words, offsets = words_of(texts)
    return words, np.diff(offsets)


def _byte_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Pieces for byte-level tokenizers: a word with one space before it, or a run of other white space.

    Where each run of white space is one blank or line feed, Arrow cuts the texts; other ASCII runs
    take a regular expression, and a text with any other white space is one piece.
    """
    odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
    runs = pc.match_substring_regex(texts, _RUNS).to_numpy(zero_copy_only=False) & ~odd
    plain = ~(odd | runs)
    marked = pc.replace_substring(pc.replace_substring(texts.filter(pa.array(plain)), " ", "\0 "), "\n", "\0\n\0")
    cut = pc.split_pattern(marked, "\0")
    counts = np.ones(len(texts), np.int64)
    counts[plain] = pc.list_value_length(cut).to_numpy(zero_copy_only=False)
    if plain.all():
        return cut.flatten(), counts
    flat, begin = cut.flatten(), offsets_of(counts[plain])
    parts, at = [], 0
    for i, text in enumerate(texts):
        if plain[i]:
            parts.append(flat.slice(begin[at], begin[at + 1] - begin[at]))
            at += 1
            continue
        found = _PIECE.findall(text.as_py()) if runs[i] else [text.as_py()]
        counts[i] = len(found)
        parts.append(pa.array(found, pa.large_string()))
    return pa.chunked_array(parts, pa.large_string()).combine_chunks(), counts


def _encode_joined(model: _Loaded, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the pieces in a row and their offsets; pieces match _JOINS.

    Many pieces are encoded as one text, with line feeds between them, which end pre-tokens; the bytes
    that tokens stand for tell where a piece's ids end.  Where they do not fit, pieces are encoded one by one.
    """
    length = pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.append(np.arange(0, len(pieces), JOINED), len(pieces))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pieces.cast(pa.string())), "\n").to_pylist()
    every, counts = [], np.zeros(len(pieces), np.int64)
    for text, begin, end in zip(joined, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        ids, size = np.array(model.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32), length[begin:end]
        at = offsets_of(model.sizes[ids])
        first = offsets_of(size + (not model.drops_space))[:-1]
        a, b = np.searchsorted(at, first), np.searchsorted(at, first + size)
        if b.max() < len(at) and (at[a] == first).all() and (at[b] == first + size).all() and first[-1] + size[-1] == at[-1]:
            if not model.drops_space:  # without the line feeds
                ids = np.delete(ids, b[:-1])
            counts[begin:end] = b - a
        else:
            found = model.encode(pieces.slice(begin, end - begin).to_pylist())
            ids = np.array([x for some in found for x in some], np.uint32)
            counts[begin:end] = [len(x) for x in found]
        every.append(ids)
    return np.concatenate(every) if every else np.zeros(0, np.uint32), offsets_of(counts)


def _gather(ids: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs `codes` of ids in a row, and their lengths."""
    sizes = np.diff(offsets)[codes]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.repeat(offsets[:-1][codes] - ends + sizes, sizes) + np.arange(total)], sizes


def _encode_distinct(model: _Loaded, distinct: pa.Array, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct pieces in a row and their offsets."""
    known = pc.index_in(distinct, value_set=model.kept).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    missing = known < 0
    joins = pc.match_substring_regex(distinct, _JOINS).to_numpy(zero_copy_only=False)
    together, alone = np.flatnonzero(missing & joins), np.flatnonzero(missing & ~joins)
    held = _gather(model.ids, model.offsets, known[~missing])[0]
    ids, offsets = _encode_joined(model, distinct.take(pa.array(together)))
    single = model.encode(distinct.take(pa.array(alone)).to_pylist())
    sizes = np.zeros(len(distinct), np.int64)
    sizes[~missing] = np.diff(model.offsets)[known[~missing]]
    sizes[together] = np.diff(offsets)
    sizes[alone] = [len(x) for x in single]
    # Kept ones, joined ones and single ones in a row, then in the order of the pieces.
    order = np.concatenate((np.flatnonzero(~missing), together, alone))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    row = np.concatenate((held, ids, np.array([x for some in single for x in some], np.uint32)))
    begins = offsets_of(sizes[order])
    out, _ = _gather(row, begins, place)
    offsets = offsets_of(sizes)
    if room := KEPT_PIECES - len(model.kept):
        short = pc.less_equal(pc.binary_length(distinct), KEPT_LENGTH).to_numpy(zero_copy_only=False)
        new = np.flatnonzero(missing & repeated & short)[:room]
        if len(new):
            some, lengths = _gather(out, offsets, new)
            model.keep(distinct.take(pa.array(new)), some, offsets_of(lengths))
    return out, offsets


def _encode_plain(model: _Loaded, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    pieces, counts = (_by_word if model.drops_space else _byte_pieces)(texts)
    if not len(pieces):
        return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
    coded = pieces.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ids, offsets = _encode_distinct(model, coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)) > 1)
    ids, sizes = _gather(ids, offsets, codes)
    return ids, offsets_of(sums_by(sizes, offsets_of(counts)))


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts in a row, and the offsets at which each text's ids begin; null texts are empty.

    These are the library's own ids without added ends: an added token that is written in a text is that token.
    """
    model, texts = _loaded(path), strings(texts)
    marked = pc.match_substring_regex(texts, model.pattern).to_numpy(zero_copy_only=False) if model.added else np.zeros(len(texts), bool)
    if not marked.any():
        return _encode_plain(model, texts)
    cut = re.compile(f"({model.pattern})")
    parts, tokens, counts = [], [], []
    for text, some in zip(texts.to_pylist(), marked.tolist(), strict=True):
        found = cut.split(text) if some else [text]
        parts += found[::2]
        tokens += [*(model.added[t] for t in found[1::2]), -1]
        counts.append(len(found[::2]))
    ids, offsets = _encode_plain(model, pa.array(parts, pa.large_string()))
    tokens = np.array(tokens, np.int64)
    put = np.flatnonzero(tokens >= 0)
    ids = np.insert(ids, offsets[1:][put], tokens[put].astype(np.uint32))
    return ids, offsets_of(sums_by(np.diff(offsets) + (tokens >= 0), offsets_of(np.array(counts, np.int64))))


def append_id(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with `end_id` after each text's ids."""
    n = len(offsets) - 1
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(n + 1)
