import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as tokenizers
import pytest
from tokenizers import Tokenizer

from affinityloom.llm import packing
from affinityloom.llm.common import scratch_path

WORDS = tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


def first_fit(sizes, capacity):
    """Plain search for the first sequence with room, longest first."""
    room, placed = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if s == len(room):
            room.append(capacity)
        placed[i] = (s, capacity - room[s])
        room[s] -= sizes[i]
    return [placed[i] for i in range(len(sizes))]


def test_tree_finds_the_first_room():
    rng = random.Random(4)
    for n in (1, 2, 3, 50, 700):
        sizes = [rng.randint(1, 40) for _ in range(n)]
        got = packing.first_fit_decreasing(np.array(sizes), 40)
        assert list(zip(*(x.tolist() for x in got))) == first_fit(sizes, 40)


def test_chunks_give_the_ids_of_whole_texts(library):
    rng = random.Random(9)
    letters = "aAbZéÉßÿ×÷ǅĿ'  \n\t.,;:!?\x1c\x1d\x85 　\xa01²½ªµΣςİĶ̱́東京👍🏽\x00H_-+"
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "don't", "I'LL 've", "word.'re", "é.", "H̱"]
    encoder = packing.ChunkEncoder(WORDS)
    texts = ["".join(rng.choice(parts) if rng.random() < 0.1 else rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("which", ["rows", "odd"])
@pytest.mark.parametrize("group_bytes", [1 << 24, 1 << 14])
def test_pieces_hold_every_id_once(spark, frame, request, library, tmp_path_factory, which, group_bytes):
    pairs = request.getfixturevalue(which)
    folder = scratch_path(spark, "packed")
    packing.pack(frame(pairs), WORDS, folder, group_bytes=group_bytes)
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in pairs}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in packing.read_pieces(spark, folder).collect():
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts, whole in [*((p, len(ids[i])) for i, p in by_doc.items()), *((p, None) for p in by_sequence.values())]:
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [s for s, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] == (whole or min(ends[-1], 4096))
    assert set(by_doc) == set(ids)
    stored = spark.read.parquet(folder).collect()
    assert all(len(s.ids) == 4 * s.n_tokens <= 4 * s.padded_length <= 4 * 4096 for s in stored)


def test_little_padding(spark, sf_dir):
    folder = scratch_path(spark, "packed")
    packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORDS, folder)
    held, padded = spark.read.parquet(folder).selectExpr("sum(n_tokens)", "sum(padded_length)").first()
    assert held / padded > 0.97


def test_repeated_rows_null_ids_and_extra_columns(spark):
    rows = [(7, "some text", "a")] * 300 + [(None, "no id", "b"), (7, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    folder = scratch_path(spark, "packed")
    packing.pack(docs, WORDS, folder, group_bytes=1 << 9)
    got = packing.read_pieces(spark, folder).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 1
    # Equal rows don't all meet in one group.
    assert len({r.sequence_id >> 32 for r in got}) > 3


def test_empty(spark, frame):
    assert packing.packing_digest(frame([]), WORDS).collect() == []
