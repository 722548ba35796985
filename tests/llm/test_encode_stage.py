import hashlib
import random

import pytest

import corpus_pipeline
from affinityloom.llm import byte_bpe


def test_last_stage_decodes(spark, frame, odd, sf_dir):
    got = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, frame(odd), sf_dir).collect()}
    for i, t in odd:
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert len(got[i]["ids"]) == 4 * got[i]["n_tokens"]


def test_codec_gives_the_text_back(odd):
    c = byte_bpe.codec(byte_bpe_path(), pattern())
    assert all(c.decode(c.encode(t or "")) == (t or "").encode() for _, t in odd)


def byte_bpe_path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


def pattern():
    return pytest.importorskip("public_tokenizers").PATTERN


def test_merges_equal_a_plain_loop_with_the_bytes_ranked_once(odd):
    c = byte_bpe.codec(byte_bpe_path(), pattern())
    rng = random.Random(4)
    pieces = [bytes(rng.choice(b"abst e") for _ in range(rng.randrange(1, 60))) for _ in range(200)] + [bytes(rng.randrange(256) for _ in range(40)) for _ in range(50)]
    for piece in [*pieces, b"aaaaaaaaaaaaa", "Straße東京".encode()]:
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while (best := min(((c.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in c.ranks), default=None)):
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert byte_bpe.merge(piece, c.ranks, c.first) == [c.ranks[x] for x in parts]
