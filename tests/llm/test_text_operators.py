import base64
import hashlib
import random

import numpy as np
import public_tokenizers as tokenizers
import pytest
import tiktoken

from affinityloom.llm import byte_bpe, line_dedup, secret_ledger
from affinityloom.llm.common import SPACED, scratch_path, words

from . import brute


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("which", ["rows", "odd"])
def test_line_dedup(frame, request, which):
    pairs = request.getfixturevalue(which)
    assert by_id(line_dedup.line_dedup_digest(frame(pairs))) == brute.line_dedup(pairs)


@pytest.mark.parametrize("which", ["rows", "odd"])
def test_secrets(frame, request, which):
    pairs = request.getfixturevalue(which)
    assert by_id(secret_ledger.secret_digest(frame(pairs))) == brute.secrets(pairs)


def test_ledger_scans_only_unseen_blobs(spark, frame, odd):
    path = scratch_path(spark, "ledger")
    first = frame(odd[:8]).selectExpr("doc_id as path", "text")
    both = frame(odd + odd).selectExpr("doc_id as path", "text")
    secret_ledger.update_ledger(first, path, seen=False)
    got = secret_ledger.update_ledger(both, path)
    assert got.count() == got.select("blob").distinct().count() == len({t or "" for _, t in odd})
    assert secret_ledger.findings_by_path(both, got).count() == 2 * len(odd)


@pytest.mark.parametrize("which", ["rows", "odd"])
def test_bpe_equals_library(frame, request, which):
    pairs = request.getfixturevalue(which)
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in pairs:
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t or ""))
    assert by_id(byte_bpe.encode_texts(frame(pairs), path, tokenizers.PATTERN, ["doc_id"])) == want


def test_bpe_random_pretokens():
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    for size in (2, 7, 30, 400, 3000):
        for letters in ("ab", "etaoin shrdlu", "éè東京x "):
            text = "".join(rng.choice(letters) for _ in range(size))
            assert byte_bpe.merge(text.encode(), ranks) == library.encode_ordinary(text)


def test_word_hashes(odd):
    import re

    texts = [(t or "") for _, t in odd]
    hashes, bounds = words([t.encode() for t in texts], SPACED)
    flat = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t.translate(brute.LOW))]
    assert len(flat) == len(hashes) and len(set(flat)) == len(set(hashes.tolist()))
    assert len({(a, int(b)) for a, b in zip(flat, hashes)}) == len(set(flat))
    assert bounds[-1] == len(flat)


def test_word_hashes_of_many_texts_hold_little(odd):
    """What hashing holds beside its result doesn't grow with the batch, and runs of texts give what each text gives."""
    import tracemalloc

    texts = [(t or "").encode() for _, t in odd] * 3 + [b"one Two  three " * 400] * 1500
    tracemalloc.start()
    hashes, bounds = words(texts, SPACED)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(len(t) for t in texts)
    for k in (0, 5, len(odd) + 3, len(texts) - 1):
        assert hashes[bounds[k]:bounds[k + 1]].tolist() == words([texts[k]], SPACED)[0].tolist()


@pytest.mark.parametrize("which", ["rows", "odd"])
def test_token_codes(frame, request, which):
    import zlib

    from tokenizers import Tokenizer

    from affinityloom.llm import token_codes

    pairs = request.getfixturevalue(which)
    path = tokenizers.path("byte_bpe_50k.json")
    t, start, want = Tokenizer.from_file(path), 0, {}
    for i, text in sorted(pairs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert by_id(token_codes.token_codes(frame(pairs), path)) == want


def test_codes_random_access():
    from affinityloom.llm.token_codes import Codes, pack

    for high in (200, 256, 50257, 2**20, 2**32):
        ids = np.random.default_rng(high).integers(0, high, 3001).astype(np.uint32)
        codes = Codes(pack(ids))
        assert [codes[i] for i in range(0, 3001, 7)] == ids[::7].tolist()
        for a, b in ((0, 3001), (5, 6), (511, 513), (1000, 1000), (2990, 3001)):
            assert codes.slice(a, b).tolist() == ids[a:b].tolist()


@pytest.mark.parametrize("which", ["rows", "odd"])
def test_decontamination(spark, frame, request, sf_dir, which):
    from affinityloom.llm import decontaminate

    pairs = request.getfixturevalue(which)
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    if which == "odd":
        long = " ".join(f"w{i % 5}" for i in range(60))
        items = [(1, "one two"), (2, None), (3, "..."), (4, pairs[8][1]), (10, "One"), (11, long)]
        pairs = [*pairs, (100, long), (101, "z " * 300 + long), (102, long + " " + long), (103, "one two " * 20)]
    got = decontaminate.decontamination_digest(frame(pairs), spark.createDataFrame(items, "item_id long, text string"))
    assert {k: v[:5] for k, v in by_id(got).items()} == brute.contamination(pairs, items)


def test_decontamination_in_blocks(spark, frame, odd, monkeypatch):
    from affinityloom.llm import decontaminate

    items = spark.createDataFrame([(1, "one two"), (2, None), (4, odd[8][1]), (10, "One"), (11, "nowhere to be found")], "item_id long, text string")
    whole = {k: v[:5] for k, v in by_id(decontaminate.decontamination_digest(frame(odd), items)).items()}
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 2)
    monkeypatch.setattr(decontaminate, "QUERIES_AT_ONCE", 3)
    assert {k: v[:5] for k, v in by_id(decontaminate.decontamination_digest(frame(odd), items)).items()} == whole
