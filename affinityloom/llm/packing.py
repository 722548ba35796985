"""Packing of token ids into fixed-length sequences: first-fit decreasing inside random groups.

A document is cut every ``capacity`` ids, so all its pieces but the last fill a sequence alone. The
last pieces of a group are put, longest first, into the first sequence with room for them; a
tournament tree over the free room of the sequences finds it. Groups share nothing, so they run
side by side and one that is lost is packed again alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.llm.common import scratch_path

CAPACITY = 4096
#: UTF-8 bytes of text behind a group; a group holds at most that many ids, on average.
GROUP_BYTES = 1 << 22
#: Chunks of text whose ids a worker remembers.
CACHE_CHUNKS = 600_000

_SPACED = re.compile(r"[^\x09-\x0D\x20]+")
#: Characters with which ``str.split`` or lower-casing before the library normalises could change the ids.
_PLAIN_UNLIKE = re.compile("[\x1c-\x1f\u0300-\U0010ffff]")
#: In every text a letter and the full stop, comma or the like after it are apart.
_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
_STOP = re.compile(r"[.,;:!?](?<=[a-zß-öø-ÿ].)")


class ChunkEncoder:
    """The library's ids of whole texts, from the ids of their chunks.

    For tokenizers that lower-case, drop white space and never join letters across a blank or from a
    letter to a full stop: there the ids of a text are those of its chunks, one after the other. Each
    chunk is encoded by the library once while it is remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # the special tokens' strings in a text are ordinary text
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    @staticmethod
    def chunks(text: str) -> list[str]:
        if _PLAIN_UNLIKE.search(text):
            return _SPACED.findall(text)
        return _STOP.sub(r" \g<0>", text.encode().lower().decode()).split()

    def learn(self, chunks: list[str]) -> None:
        """Remember the ids of chunks; words of letters go to the library many at a time, as one text."""
        words, others = [], []
        for c in chunks:
            (words if _LETTERS.fullmatch(c) else others).append(c)
        for first in range(0, len(words), 512):
            part = words[first:first + 512]
            ids = np.array(self.library.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(part):
                others += part
                continue
            data, at = ids.tobytes(), 0
            for word, end in zip(part, (4 * ends).tolist()):
                self.known[word] = data[at:end]
                at = end
        for first in range(0, len(others), 1024):
            part = others[first:first + 1024]
            for chunk, e in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False)):
                self.known[chunk] = np.array(e.ids, "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        known = self.known
        split = [self.chunks(t or "") for t in texts]
        found = [list(map(known.get, chunks)) for chunks in split]
        unknown = [[i for i, ids in enumerate(row) if ids is None] for row in found]
        self.learn(list({chunks[i] for chunks, places in zip(split, unknown) for i in places}))
        for chunks, row, places in zip(split, found, unknown):
            for i in places:
                row[i] = known[chunks[i]]
        return [np.frombuffer(b"".join(row), "<u4") for row in found]


@lru_cache(2)
def _encoder(path: str) -> ChunkEncoder:
    """One encoder per worker; one thread of the library each, as the cores run tasks already."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path)


class RoomTree:
    """Tournament tree over the free room of sequences: each node holds the most room below it."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first sequence with room: the sequence and what it held before."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        sequence, before = node - self.leaves, room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
        return sequence, before


def first_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each size (1 to ``capacity``); equal sizes keep their order."""
    sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree = RoomTree(len(sizes), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        sequence[i], room = tree.place(int(sizes[i]))
        offset[i] = capacity - room
    return sequence, offset


PIECES = "slot int, doc_id bigint, start bigint, length int, doc_tokens bigint, ids binary"
SEQUENCES = ("sequence_id bigint, n_tokens int, padded_length int, ids binary, "
             "pieces array<struct<doc_id: bigint, start: bigint, length: int, doc_tokens: bigint, offset: int>>")


def tokenized_pieces(docs: DataFrame, tokenizer: str, groups: int, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids (null text: none) and ``end_id``, cut every ``capacity`` ids, with a random group.

    The group follows from id, start and the ids themselves, and for repeated rows from how often a task has met
    them: a repeated task deals alike, and a third of all rows under one id spread over all groups.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = _encoder(tokenizer), Counter()
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                rows = []
                for doc_id, row in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    data = np.append(row, np.uint32(end_id)).astype("<u4").tobytes()
                    key = zlib.crc32(data, zlib.crc32(str(doc_id).encode()))
                    met[key] += 1
                    for start in range(0, len(data) // 4, capacity):
                        piece = data[4 * start:4 * (start + capacity)]
                        slot = zlib.crc32(b"%d:%d:%d" % (key, met[key], start)) % groups
                        rows.append((slot, doc_id, start, len(piece) // 4, len(data) // 4, piece))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                    ["slot", "doc_id", "start", "length", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _packed_group(capacity: int):
    kind = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("offset", pa.int32())])

    def pack(rows: pa.Table) -> pa.Table:
        slot = rows.column("slot")[0].as_py()
        ids, start = rows.column("ids").to_pylist(), rows.column("start").to_numpy()
        doc_id, total = rows.column("doc_id").to_pylist(), rows.column("doc_tokens").to_numpy()
        length = rows.column("length").to_numpy().astype(np.int64)
        # Rows arrive in any order: the order by content makes a repeated task pack alike.
        order = sorted(range(len(ids)), key=lambda i: (-length[i], doc_id[i] is None, doc_id[i] or 0, start[i], ids[i]))
        sequence, offset = first_fit_decreasing(length[order], capacity)
        out: list[list] = [[] for _ in range(int(sequence.max()) + 1)]
        for i, s, o in zip(order, sequence.tolist(), offset.tolist()):
            out[s].append((i, o))
        held = [sum(int(length[i]) for i, _ in s) for s in out]
        pieces = [[{"doc_id": doc_id[i], "start": int(start[i]), "length": int(length[i]), "doc_tokens": int(total[i]), "offset": o}
                   for i, o in s] for s in out]
        return pa.table({
            "sequence_id": pa.array([slot << 32 | s for s in range(len(out))], pa.int64()),
            "n_tokens": pa.array(held, pa.int32()),
            "padded_length": pa.array([n if n & (n - 1) == 0 else capacity for n in held], pa.int32()),
            "ids": pa.array([b"".join(ids[i] for i, _ in s) for s in out], pa.binary()),
            "pieces": pa.array(pieces, pa.list_(kind))})

    return pack


def pack(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, capacity: int = CAPACITY, group_bytes: int = GROUP_BYTES) -> None:
    """Write packed sequences to ``folder`` as Parquet: sequence_id, n_tokens, padded_length, ids (little-endian u32) and pieces.

    The pieces of a sequence lie one after the other from offset 0; padding up to ``padded_length`` is left to the
    loader. A sequence whose ids number a power of two needs none. A null or empty text is its end id alone; a null
    doc_id stays null; repeated rows are packed each; an empty table gives no sequence.
    """
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    pieces = tokenized_pieces(docs, tokenizer, max(1, -(-size // group_bytes)), end_id, capacity)
    pieces.groupBy("slot").applyInArrow(_packed_group(capacity), SEQUENCES).write.parquet(folder)


def read_pieces(spark, folder: str) -> DataFrame:
    """One row per piece, its digest from the stored sequences' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = batch.column("pieces")
            flat, per = pieces.flatten(), np.diff(pieces.offsets.to_numpy())
            offset, length = flat.field("offset").to_numpy(), flat.field("length").to_numpy()
            owner = np.repeat(np.arange(batch.num_rows), per)
            ids = [memoryview(b.as_buffer()) for b in batch.column("ids")]
            crcs = [zlib.crc32(ids[s][4 * o:4 * (o + n)]) for s, o, n in zip(owner.tolist(), offset.tolist(), length.tolist())]
            yield pa.RecordBatch.from_pydict({
                "doc_id": flat.field("doc_id"), "start": flat.field("start"), "length": length.astype(np.int64),
                "ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": flat.field("doc_tokens"),
                "sequence_id": batch.column("sequence_id").take(pa.array(owner)), "offset": offset.astype(np.int64)})

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return spark.read.parquet(folder).select("sequence_id", "ids", "pieces").mapInArrow(run, schema)


def packing_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "packed")
    pack(docs, tokenizer, folder)
    return read_pieces(docs.sparkSession, folder)
