"""Every operator's query against a brute-force version over whole texts."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash

from skeinlake.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def run(spark, sf_dir, name):
    from skeinlake.session import ship

    key = next(k for k in queries.QUERIES if k.startswith(name + "_"))
    return [r.asDict() for r in queries.QUERIES[key](ship(spark), sf_dir).collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    return t


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1_token_blocks(spark, sf_dir, texts):
    t, start, want = tokenizer("word_bpe_49k.json"), 0, {}
    for doc in sorted(texts):
        ids = t.encode(texts[doc], add_special_tokens=False).ids + [2]
        want[doc] = (start, len(ids), crc(ids))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in run(spark, sf_dir, "op1")}
    assert got == want


def test_op2_substring_dedup(spark, sf_dir, texts):
    seen, want = set(), {}
    for doc in sorted(texts):
        words = WORD.findall(texts[doc])
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            window = tuple(words[i : i + 20])
            if window in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(window)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        want[doc] = (len(words), sum(gone), sha(" ".join(kept)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run(spark, sf_dir, "op2")}
    assert got == want


def test_op3_best_fit_packing(spark, sf_dir, texts):
    t, want = tokenizer("byte_bpe_50k.json"), {}
    for doc, text in texts.items():
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        first, at, piece = len(ids) % 1024 or min(len(ids), 1024), 0, 0
        while at < len(ids):
            n = first if at == 0 else 1024
            want[doc, piece] = (at, n, crc(ids[at : at + n]))
            at, piece = at + n, piece + 1
    rows = run(spark, sf_dir, "op3")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(places) <= 1 + 1.02 * sum(r["length"] for r in rows) / 1024


def test_op4_sentence_pieces(spark, sf_dir, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in run(spark, sf_dir, "op4"):
        ids = model.encode(texts[r["doc_id"]])
        assert (r["n_pieces"], r["ids_crc32"]) == (len(ids), crc(ids)), r["doc_id"]
        assert r["decoded_sha256"] == sha(model.decode(ids)), r["doc_id"]
        assert r["round_trip"] == (model.decode(ids) == texts[r["doc_id"]])


def luhn(digits):
    doubled = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def base_spans(text):
    for kind, pattern in {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))) or (kind == "card" and 16 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 8 <= len(digits) <= 15):
                yield kind, m.start(), m.end()


def test_op5_personal_data(spark, sf_dir, texts):
    for r in run(spark, sf_dir, "op5"):
        base = list(base_spans(texts[r["doc_id"]]))
        n = Counter(k for k, _, _ in base)
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [n["email"], n["ip"], n["card"], n["phone"]]
        assert r["base_sha256"] == sha(",".join(listed))
        assert set(listed) <= set(r["spans"].split(",")) | {""}


def test_op6_line_quality(spark, sf_dir, texts):
    for r in run(spark, sf_dir, "op6"):
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        times, covered = Counter(windows), set()
        for i, w in enumerate(windows):
            if times[w] > 1:
                covered.update(range(i, i + 8))
        lines = [line for line in text.split("\n") if WORD.search(line)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(words) < 20 or 100 * len(covered) > 30 * len(words))
        assert not (r["kept"] and r["base_failed"])


def test_op7_language_id(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in run(spark, sf_dir, "op7")}
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(sf_dir + "/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    assert set(rows) == set(texts)
    for doc, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in texts[doc]))
    judged = [lang[d] == r["lang_pred"] for d, r in rows.items() if r["held_out"] and lang[d] and r["lang_pred"] != "und"]
    assert len(judged) > 20 and np.mean(judged) > 0.9


def test_op8_warc(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in pq.read_table(sf_dir + "/pages.parquet").to_pylist()}
    last = {}
    for page in sorted(pages):
        last[pages[page]] = page
    want = {p: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if last[b] == p else "revisit", None if last[b] == p else last[b]) for p, b in pages.items()}
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in run(spark, sf_dir, "op8")} == want


def test_op9_exact_dedup(spark, sf_dir, texts):
    groups = defaultdict(list)
    for doc, text in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append(doc)
    want = {}
    for text, docs in groups.items():
        keep = min(docs, key=lambda d: (-len(texts[d]), d))
        want |= {d: (keep, len(docs), d == keep, sha(text)) for d in docs}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in run(spark, sf_dir, "op9")} == want


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op10_simhash(spark, sf_dir, texts):
    prints = {d: fingerprint(t) for d, t in texts.items()}
    docs = sorted(prints)
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {d: (f"{prints[d]:016x}", find(d)) for d in docs}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, sf_dir, "op10")} == want


@pytest.mark.parametrize("bits", [3, 8])
def test_trie_join_against_all_pairs(bits):
    from skeinlake.llm.simhash import trie_forest

    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [int(s) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 4), replace=False)) for s in np.repeat(seeds, 6)]
    fps = np.unique(np.array(near, np.uint64))
    member, first = trie_forest(fps, np.zeros(len(fps), np.int64), bits)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(fps)):
        for b in range(a):
            if int(fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = [find(i) for i in range(len(fps))]
    got = list(range(len(fps)))
    for m, f in zip(member.tolist(), first.tolist(), strict=True):
        got[m] = f
    groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == x).tolist()) for x in set(labels)}
    assert groups(got) == groups(want)


def test_blocks_round_trip():
    from skeinlake.llm.token_blocks import decode_blocks, encode_blocks

    rng = np.random.default_rng(3)
    for n in (1, 127, 128, 129, 5000):
        ids = rng.integers(0, 50_000, n).astype(np.uint32)
        ids[rng.integers(0, n, n // 20 + 1)] = 2**32 - 1
        blocks = encode_blocks(ids)
        starts = np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1]))
        assert (decode_blocks(b"".join(blocks), starts) == ids).all()
