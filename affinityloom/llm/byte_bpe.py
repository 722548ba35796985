"""Byte-level BPE with a hierarchical-bitmap rank queue."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CACHE_WORDS = 400_000


_BIT = [1 << i for i in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], first: list[int] | None = None) -> list[int]:
    """Token ids of one pre-token: merge the least rank, leftmost first, until no pair has a rank.

    The queue holds positions by merge rank. Its bitmaps find the least rank that has any: bit ``rank & 255`` of the word
    ``low[rank >> 8]``, and bit ``rank >> 8`` of ``top`` where that word has any. A rank's positions are one number or a
    heap. It is written out in the loop, since calls would cost more than the steps themselves. ``first`` is ``byte_pairs``.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    get, bit = ranks.get, _BIT
    n = len(piece)
    first = byte_pairs(ranks) if first is None else first
    pair_rank = [first[a << 8 | b] for a, b in zip(piece, piece[1:])]
    pair_rank.append(-1)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    top, low, buckets = 0, {}, {}
    for i, rank in enumerate(pair_rank):
        if rank < 0:
            continue
        if rank in buckets:
            held = buckets[rank]
            if held.__class__ is int:
                buckets[rank] = [held, i]
            else:
                held.append(i)  # places ascend, so the list is a heap
            continue
        buckets[rank] = i
        high = rank >> 8
        if high in low:
            low[high] |= bit[rank & 255]
        else:
            low[high] = bit[rank & 255]
            top |= bit[high] if high < 256 else 1 << high
    while top:
        high = (top & -top).bit_length() - 1
        word = low[high]
        least = word & -word
        rank = high << 8 | least.bit_length() - 1
        i = buckets[rank]
        if i.__class__ is not int:
            bucket = i
            i = heappop(bucket)
            if len(bucket) == 1:
                buckets[rank] = bucket[0]
        else:
            del buckets[rank]
            if word == least:
                del low[high]
                top &= top - 1
            else:
                low[high] = word ^ least
        if pair_rank[i] != rank:
            continue  # stale: the pair changed since
        j = after[i]
        after[i] = k = after[j]
        before[k] = i
        pair_rank[j] = -1
        pair_rank[i] = -1
        left = before[i]
        for i, end in ((i, after[k] if k < n else 0), (left, k if left >= 0 else 0)):
            if not end:
                continue
            rank = get(piece[i:end])
            if rank is None:
                pair_rank[i] = -1
                continue
            pair_rank[i] = rank
            if rank in buckets:
                held = buckets[rank]
                if held.__class__ is int:
                    buckets[rank] = [held, i] if held < i else [i, held]
                else:
                    heappush(held, i)
                continue
            buckets[rank] = i
            high = rank >> 8
            if high in low:
                low[high] |= bit[rank & 255]
            else:
                low[high] = bit[rank & 255]
                top |= bit[high] if high < 256 else 1 << high
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:after[i]]])
        i = after[i]
    return out


def byte_pairs(ranks: dict[bytes, int]) -> list[int]:
    """The rank of each pair of bytes at ``first << 8 | second``, -1 where it has none."""
    return [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]


class Codec:
    """Encoder and decoder of one rank file; pre-tokens seen before come from a bounded cache."""

    def __init__(self, lines: list[bytes], pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.first = byte_pairs(self.ranks)
        self.vocab = {v: k for k, v in self.ranks.items()}
        # White space is the Unicode property, which leaves out the separators 1C to 1F.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        self.cache: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = merge(piece.encode(), self.ranks, self.first)
        got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            if len(self.cache) >= CACHE_WORDS:
                self.cache.clear()
            self.cache[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        cache, piece = self.cache.get, self._piece
        return b"".join([cache(p) or piece(p) for p in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker. The file is part of the tokenizers' installation on every machine."""
    with open(path, "rb") as f:
        return Codec(f.read().splitlines(), pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, keep: list[str], digest: bool = True) -> DataFrame:
    """``keep`` columns plus n_tokens and either digests or ``ids`` (binary, little-endian u32) with the digest of the decoded text.

    Ids are decoded in both forms; without digests, ids that do not give the text back are an error.

    Null texts count as empty, which has no tokens. One row in, one row out, no shuffle.
    """
    source = docs.select(*keep, *([] if "text" in keep else ["text"]))
    kept = source.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [c.encode(t) for t in texts]
                decoded = [c.decode(x) for x in ids]
                columns = {k: part.column(k) for k in keep}
                columns["n_tokens"] = pa.array([len(x) // 4 for x in ids], pa.int64())
                if digest:
                    columns["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
                else:
                    if any(d != t.encode() for d, t in zip(decoded, texts)):
                        raise ValueError("decoded ids differ from the text")
                    columns["ids"] = pa.array(ids, pa.binary())
                columns["decoded_sha256"] = pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ids_sha256 string, decoded_sha256 string" if digest else ", ids binary, decoded_sha256 string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", n_tokens bigint" + kinds
    return source.mapInArrow(run, schema)
