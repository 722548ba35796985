"""op5's ids from remembered chunks are the library's ids of the whole texts."""

import random

import numpy as np
import pytest

from affinityloom.llm.token_codes import ChunkIds

PARTS = [" ", " ", "  ", "\n", "\t", " ", "　", " ", "​", "᠎", "﻿", "\x1c", "\x85", "a", "Bc", "don't", "'s", "12", "é", "東", "!", "...",
         "̀", "\U0001f600", "<|endoftext|>", "Ġ", "\x00"]


def test_ids_equal_the_library(odd):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    chunks = ChunkIds(path)
    rng = random.Random(1)
    texts = [t or "" for _, t in odd] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(3000)]
    whole = chunks.library.encode_batch_fast(texts, add_special_tokens=False)
    for _ in range(2):
        assert chunks.encode(texts) == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_a_remembered_chunk_does_not_go_to_the_library_again(odd):
    chunks = ChunkIds(pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json"))
    first = chunks.encode([t or "" for _, t in odd])
    chunks.library = None
    assert chunks.encode([t or "" for _, t in odd]) == first
