"""Token ids of odd texts and written added tokens against the library, text by text."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow as pa
import pytest

from skeinlake.llm import tokens

ALPHABET = [*"abcXYZ019.,!?'\"-_#$%&@|<>  \n\t\r\x0b\x0c\x00\x1c\x85\xa0 　éßİΣςǅȺẞK;·你好の한ع́̈🙂‍﻿", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", " the", " and", "\n\n", "  "]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_odd_texts(name):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = [None, "", "<|endoftext|>", "a<|endoftext|>b", " <|endoftext|> ", "hello <|endoftext|> world", "x<|startoftext|><|endoftext|>y", "word" * 4000]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 8))) for _ in range(20)) for _ in range(1000)]
    for begin in range(0, len(texts), 700):  # kept pieces serve later slices
        some = texts[begin : begin + 700]
        ids, offsets = tokens.encode(pa.array(some, pa.string()), path)
        for i, text in enumerate(some):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)
