"""Token ids as directly addressable codes: any token is read without decoding its block.

Format of one block (little-endian): magic ``DAC1``, u8 levels, u8 chunk bits (8), u16 zero,
u64 tokens; then per level u64 entries, the chunks (one byte each), and, but for the last
level, a bitmap of continuations (bit i, least significant first) and a rank directory: u32
set bits before each 512 bits. An id's low byte is at level 0; where the bit is set, its next
byte is at level 1, at the rank of that bit, and so on.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.llm.common import scratch_path
from affinityloom.operators.ordering import with_running_total

HEAD = "<4sBBHQ"
PER_BLOCK = 512
BLOCK_TOKENS = 1 << 20
#: Chunks of text whose ids a worker remembers.
CACHE_CHUNKS = 400_000
_SET_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        levels.append(((rest & 0xFF).astype(np.uint8), more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [struct.pack(HEAD, b"DAC1", len(levels), 8, 0, len(ids))]
    for k, (chunks, more) in enumerate(levels):
        out += [struct.pack("<Q", len(chunks)), chunks.tobytes()]
        if k + 1 < len(levels):
            bitmap = np.packbits(more, bitorder="little")
            bitmap = np.pad(bitmap, (0, -len(bitmap) % (PER_BLOCK // 8)))
            per = _SET_BITS[bitmap].reshape(-1, PER_BLOCK // 8).sum(1, dtype=np.uint32)
            out += [bitmap.tobytes(), (np.cumsum(per, dtype=np.uint32) - per).tobytes()]
    return b"".join(out)


class Codes:
    """Random access to one packed block."""

    def __init__(self, data: bytes):
        magic, levels, bits, _, self.tokens = struct.unpack_from(HEAD, data)
        if magic != b"DAC1" or bits != 8:
            raise ValueError("not a block of directly addressable codes")
        at, self.levels = struct.calcsize(HEAD), []
        for k in range(levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            if k + 1 < levels:
                groups = -(-n // PER_BLOCK)
                bitmap = np.frombuffer(data, np.uint8, groups * PER_BLOCK // 8, at)
                at += len(bitmap)
                directory = np.frombuffer(data, "<u4", groups, at)
                at += 4 * groups
                self.levels.append((chunks, bitmap, directory))
            else:
                self.levels.append((chunks, None, None))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i``: the directory's count and at most 64 bytes."""
        chunks, bitmap, directory = self.levels[level]
        if i >= len(directory) * PER_BLOCK:
            return len(self.levels[level + 1][0])
        first = i // PER_BLOCK * (PER_BLOCK // 8)
        count = int(directory[i // PER_BLOCK]) + int(_SET_BITS[bitmap[first:i >> 3]].sum())
        return count + int(_SET_BITS[int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value, k = 0, 0
        while True:
            chunks, bitmap, _ = self.levels[k]
            value |= int(chunks[i]) << 8 * k
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            i, k = self._rank(k, i), k + 1

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids of [start, stop); reads only their part of each level."""
        spans, a, b = [], start, stop
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            more = None
            if bitmap is not None:
                first = a >> 3
                more = np.unpackbits(bitmap[first:(b + 7) >> 3], bitorder="little")[a - 8 * first:b - 8 * first].astype(bool)
            spans.append((chunks[a:b], more))
            if bitmap is not None:
                a, b = self._rank(k, a), self._rank(k, b)
        high = np.zeros(0, np.uint32)
        for chunks, more in reversed(spans):
            out = chunks.astype(np.uint32)
            if more is not None:
                out[more] |= high << np.uint32(8)
            high = out
        return high


#: A blank after white space, where no chunk may begin.
_RUN = re.compile("[\\s\u180e\u200b\ufeff] ")
_CHUNK_START = re.compile("(?<![\\s\u180e\u200b\ufeff])(?= )")
#: Chunks that neither hold a blank nor have white space at an end: before and after them a blank begins a chunk.
_JOINS = re.compile("[^\\s\u180e\u200b\ufeff](?:[^ ]*[^\\s\u180e\u200b\ufeff])?")


class ChunkIds:
    """The library's ids of whole texts, from the ids of their chunks.

    For byte-level tokenizers whose pieces never hold white space after other characters: there a blank that follows
    such a character begins a piece, so the ids of a text are those of its chunks from blank to blank, one after the
    other. Each chunk is encoded by the library once while it is remembered.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores run tasks already
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # the special tokens' strings in a text are ordinary text
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.blank_first = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank_first[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        #: Ids by chunk, without its blank for those that begin with one.
        self.after_blank: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def learn(self, chunks: list[str]) -> None:
        """Remember chunks that begin with a blank (given without it); many go to the library as one text."""
        together, alone = [], []
        for c in chunks:
            (together if c.isalnum() or _JOINS.fullmatch(c) else alone).append(c)
        for first in range(0, len(together), 512):
            part = together[first:first + 512]
            ids = np.frombuffer(self._each([" " + " ".join(part)])[0], "<u4")
            begins = np.flatnonzero(self.blank_first[ids])
            if len(begins) != len(part):
                alone += part
                continue
            data, cuts = ids.tobytes(), [*(4 * begins).tolist(), 4 * len(ids)]
            for chunk, a, b in zip(part, cuts, cuts[1:]):
                self.after_blank[chunk] = data[a:b]
        for first in range(0, len(alone), 512):
            part = alone[first:first + 512]
            self.after_blank.update(zip(part, self._each([" " + c for c in part])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.other) > CACHE_CHUNKS // 10:
            self.other.clear()
        split = []
        for t in texts:
            if _RUN.search(t):
                first, *rest = _CHUNK_START.split(t)
                split.append([first, *[c[1:] for c in rest]])
            else:
                split.append(t.split(" "))
        known, other = self.after_blank, self.other
        heads = [chunks.pop(0) for chunks in split]
        needed = set().union(*split)
        if len(known) > CACHE_CHUNKS:  # most chunks occur once; the frequent ones are in these texts too
            kept = {c: known[c] for c in needed if c in known}
            known.clear()
            known.update(kept)
        self.learn(list(needed.difference(known)))
        new = list(set(heads).difference(other))
        other.update(zip(new, self._each(new)))
        return [other[head] + b"".join(map(known.__getitem__, chunks)) for head, chunks in zip(heads, split)]


@lru_cache(2)
def _encoder(path: str) -> ChunkIds:
    return ChunkIds(path)


def write_codes(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text (null: empty), append ``end_id`` and write blocks in ascending doc_id order.

    Documents are range-partitioned by id, so no task holds more than its range; a block closes
    after the document that brings it to ``block_tokens``. Equal ids stay as rows, in order of text;
    a null id comes first. The folder is a Parquet table of blocks: part, block, doc_ids, sizes,
    n_tokens and ``codes``, the packed bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, block = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        ids, sizes, held, total = [], [], [], 0
        end = struct.pack("<I", end_id)

        def flush():
            data = pack(np.concatenate(held)) if held else pack(np.zeros(0, np.uint32))
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "n_tokens": pa.array([total], pa.int64()), "codes": pa.array([data], pa.binary())})

        for batch in batches:
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [x or "" for x in piece.column("text").to_pylist()]
                for doc_id, data in zip(piece.column("doc_id").to_pylist(), t.encode(texts)):
                    row = np.frombuffer(data + end, "<u4")
                    ids.append(doc_id)
                    sizes.append(len(row))
                    held.append(row)
                    total += len(row)
                    if total >= block_tokens:
                        yield flush()
                        block, ids, sizes, held, total = block + 1, [], [], [], 0
        if ids:
            yield flush()

    schema = "part int, block int, doc_ids array<bigint>, sizes array<bigint>, n_tokens bigint, codes binary"
    ordered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange("doc_id")
    ordered.sortWithinPartitions("doc_id", "text").mapInArrow(run, schema).write.parquet(folder)


def read_digests(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the stored blocks."""
    blocks = spark.read.parquet(folder)
    starts = with_running_total(blocks.select("part", "block", "n_tokens"), ["part", "block"], "n_tokens", "start")
    # One narrow row a block: sent to the blocks, so their codes are not moved.
    placed = blocks.join(F.broadcast(starts.select("part", "block", "start")), ["part", "block"]).select("doc_ids", "sizes", "codes", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, sizes, data, start = (batch.column(k)[row].as_py() for k in range(4))
                codes, ends = Codes(data), np.cumsum(sizes).tolist()
                crcs = [zlib.crc32(codes.slice(e - n, e).astype("<u4").tobytes()) for e, n in zip(ends, sizes)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()),
                    "start": pa.array([start + e - n for e, n in zip(ends, sizes)], pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return placed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_codes(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "codes")
    write_codes(docs, tokenizer, folder)
    return read_digests(docs.sparkSession, folder)
