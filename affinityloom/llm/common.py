"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinityloom.session import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def _class_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Word characters by UTF-8 byte; bytes of non-ASCII characters are always word characters.
SPACED = _class_table(bytes([0x20, *range(0x09, 0x0E)]))
ALNUM = _class_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_BYTE_CODES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of text that ``words`` hashes at a time (a longer text goes alone): its arrays take some 40 times as much.
BYTES_AT_ONCE = 1 << 19


def words(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of the texts, in order, and each text's first word.

    The second array has one entry more than ``texts``. Texts are taken in runs of BYTES_AT_ONCE, so
    what is held beside the result is bounded by the longest text, not by the batch.
    """
    ends = np.cumsum(np.fromiter((len(t) for t in texts), np.int64, len(texts)))
    cuts = [0, *(np.flatnonzero(np.diff(ends // BYTES_AT_ONCE)) + 1).tolist(), len(texts)]
    parts = [_words(texts[a:b], kind) for a, b in zip(cuts, cuts[1:])]
    if len(parts) == 1:
        return parts[0]
    before = np.cumsum([0, *(len(h) for h, _ in parts)])
    return np.concatenate([h for h, _ in parts]), np.append(np.concatenate([b[:-1] + n for (_, b), n in zip(parts, before)]), before[-1])


def _words(texts: list[bytes], kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``words`` of one run of texts.

    Texts are joined by a separator, so one pass over the bytes serves a whole run. A word's hash is
    a random code per byte times an odd power of its place, summed over the word, then mixed with the
    word's length.
    """
    sep = b"\n"
    data = np.frombuffer(sep.join(texts) + sep, np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends_of_texts = np.cumsum(sizes)
    data = _LOWERED[data]
    inside = kind[data]
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.zeros(len(texts) + 1, np.int64)
    bounds[1:] = np.searchsorted(starts, ends_of_texts)
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    lengths = ends - starts
    chars = np.flatnonzero(inside)
    offset = np.arange(len(chars)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))
        terms = _BYTE_CODES[data[chars]] * powers[offset]
        sums = np.add.reduceat(terms, np.cumsum(lengths) - lengths)
        return _mix(sums ^ (lengths.astype(np.uint64) * _STEP)), bounds
