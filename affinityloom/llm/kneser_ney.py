"""Interpolated modified Kneser-Ney bigram model in sorted, memory-mapped hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.llm import files
from affinityloom.llm.common import SPACED, fold, scratch_path, stored, words

END, START = np.int64(7), np.int64(11)
CHUNK_TOKENS = 1 << 21
LOOKUP_CHARS = 4 << 20


def token_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, tokens (words, then one end a text) and each text's first place, of a batch."""
    hashes, bounds = words([(t or "").encode() for t in texts], SPACED)
    tokens = np.full(len(hashes) + len(texts), END, np.int64)
    tokens[np.arange(len(hashes)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = hashes.view(np.int64)
    begins = bounds[:-1] + np.arange(len(texts))
    contexts = np.concatenate([[START], tokens[:-1]])
    contexts[begins] = START
    return contexts, tokens, begins


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    h = (v.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ w.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def count_bigrams(docs: DataFrame) -> DataFrame:
    """(v, w, c) over all texts; tasks merge equal bigrams of some two million tokens before the shuffle."""

    def merged(held: list) -> pa.RecordBatch:
        v, w = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        _, at, n = np.unique(pair_key(v, w), return_index=True, return_counts=True)
        return pa.RecordBatch.from_pydict({"v": v[at], "w": w[at], "c": n.astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                contexts, tokens, _ = token_stream(part.column("text").to_pylist())
                held.append((contexts, tokens))
                size += len(tokens)
                if size >= CHUNK_TOKENS:
                    yield merged(held)
                    held, size = [], 0
        if held:
            yield merged(held)

    return docs.select("text").mapInArrow(run, "v bigint, w bigint, c bigint").groupBy("v", "w").agg(F.sum("c").alias("c"))


def write_arrays(rows: DataFrame, columns: list[str], folder: str) -> list[tuple[str, int, int, int]]:
    """Range-partition by ``key``, sort, and write each partition as int64 columns one after the other.

    Returns (file, first key, last key, entries) of each file, one per partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(c).to_numpy() for c in columns]) for b in batches if b.num_rows]
        if held:
            data = np.concatenate(held, axis=1)
            uri = files.put(folder, f"part-{TaskContext.get().partitionId():06d}.bin", np.ascontiguousarray(data).tobytes())
            yield pa.RecordBatch.from_pydict({"uri": [uri], "lo": [int(data[0, 0])], "hi": [int(data[0, -1])], "n": [data.shape[1]]})

    ordered = rows.select(*columns).repartitionByRange(columns[0]).sortWithinPartitions(columns[0])
    made = ordered.mapInArrow(run, "uri string, lo bigint, hi bigint, n bigint").collect()
    return sorted((tuple(r) for r in made), key=lambda r: r[1])


@lru_cache(None)
def _mapped(uri: str, columns: int, n: int) -> np.ndarray:
    path = files.local_path(uri)
    if path is not None:
        return np.memmap(path, np.int64, "r", shape=(columns, n))
    with files.opened(uri) as f:  # a store that can't be mounted: this part is read once a worker
        return np.frombuffer(f.read(), np.int64).reshape(columns, n)


def look_up(parts: list[tuple[str, int, int, int]], columns: int, keys: np.ndarray) -> np.ndarray:
    """Values (columns - 1, len(keys)) of the keys, 0 where a key is absent."""
    unique, back = np.unique(keys, return_inverse=True)
    out = np.zeros((columns - 1, len(unique)), np.int64)
    for uri, lo, hi, n in parts:
        a, b = np.searchsorted(unique, lo), np.searchsorted(unique, hi, "right")
        if a < b:
            data = _mapped(uri, columns, n)
            at = np.minimum(np.searchsorted(data[0], unique[a:b]), n - 1)
            there = data[0][at] == unique[a:b]
            for k in range(columns - 1):
                out[k, a:b] = np.where(there, data[k + 1][at], 0)
    return out[:, back]


def _discounts(n: list[int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return 0.5, 0.75, 0.9  # too few counts to estimate
    y = n1 / (n1 + 2 * n2)
    return tuple(float(np.clip(d, 0.01, k + 0.99)) for k, d in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)))


VOCAB = ["key", "c", "held", "total", "n1", "n2", "n3"]


class Model:
    """Sums, discounts and the file lists; the arrays themselves stay in the shared folder."""

    def __init__(self, vocab, bigrams, tokens: int, types: int, distinct: int, low, high, low_counts):
        self.vocab, self.bigrams, self.tokens, self.types, self.distinct = vocab, bigrams, tokens, types, distinct
        self.low, self.high, self.low_counts = low, high, low_counts

    def score_tokens(self, contexts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of the tokens and log10 of their probabilities given their contexts."""
        pair = look_up(self.bigrams, 2, pair_key(contexts, tokens))[0]
        both = look_up(self.vocab, len(VOCAB), np.concatenate([tokens, contexts]))
        c, held = both[0, :len(tokens)], both[1, :len(tokens)]
        total, n1, n2, n3 = both[2:, len(tokens):]
        uniform = 1 / (self.types + 1)
        cut = lambda x, d: np.maximum(x - np.choose(np.minimum(x, 3), (0.0, *d)), 0)
        if self.distinct:
            rest = sum(d * n for d, n in zip(self.low, self.low_counts)) / self.distinct
            lower = cut(held, self.low) / self.distinct + rest * uniform
        else:
            lower = np.full(len(tokens), uniform)
        seen = np.maximum(total, 1)
        gamma = (self.high[0] * n1 + self.high[1] * n2 + self.high[2] * n3) / seen
        return c, np.log10(np.where(total > 0, cut(pair, self.high) / seen + gamma * lower, lower))


def train(docs: DataFrame) -> Model:
    """Count every text of ``docs``; null texts are empty, each text ends in one end token."""
    spark = docs.sparkSession
    grams = stored(count_bigrams(docs), "bigrams")
    role = F.explode(F.array(
        F.struct(F.col("v").alias("key"), F.lit(0).alias("as_word")), F.struct(F.col("w").alias("key"), F.lit(1).alias("as_word"))))
    roles = grams.select("c", role.alias("r")).select("c", "r.*")
    word, context = F.col("as_word") == 1, F.col("as_word") == 0
    count_if = lambda p: F.sum(p.cast("bigint"))
    vocab = stored(roles.groupBy("key").agg(
        F.sum(F.when(word, F.col("c")).otherwise(0)).alias("c"), count_if(word).alias("held"),
        F.sum(F.when(context, F.col("c")).otherwise(0)).alias("total"),
        *[count_if(context & p).alias(f"n{k}") for k, p in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") >= 3))]), "vocabulary")
    zero = lambda row: [int(x or 0) for x in row]
    g = zero(grams.agg(F.count(F.lit(1)), *[count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first())
    v = zero(vocab.agg(F.sum("c"), count_if(F.col("c") > 0), count_if(F.col("held") >= 3), *[count_if(F.col("held") == k) for k in (1, 2, 3, 4)]).first())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"key": pair_key(b.column("v").to_numpy(), b.column("w").to_numpy()), "c": b.column("c")})

    folder = scratch_path(spark, "model")
    # Keys are made twice, for the range bounds and for the arrays; a stored copy would be as large as the arrays.
    bigrams = write_arrays(grams.mapInArrow(keyed, "key bigint, c bigint"), ["key", "c"], f"{folder}/bigrams")
    words_ = write_arrays(vocab, VOCAB, f"{folder}/vocabulary")
    return Model(words_, bigrams, v[0], v[1], g[0], _discounts(v[3:]), _discounts(g[1:]), (v[3], v[4], v[2]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measured(ids: list, texts: list[str | None], m: Model) -> pa.RecordBatch:
        contexts, tokens, begins = token_stream(texts)
        c, logs = m.score_tokens(contexts, tokens)
        base = np.log10((c + 0.5) / (m.tokens + 0.5 * (m.types + 1)))
        sums = lambda x: np.add.reduceat(x, begins)
        return pa.RecordBatch.from_pydict({
            "doc_id": pa.array(ids, pa.int64()), "n_tokens": np.diff(begins, append=len(tokens)),
            "n_known": sums((c > 0).astype(np.int64)), "train_tokens": np.full(len(ids), m.tokens, np.int64),
            "base_score": sums(base), "score": sums(logs)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= LOOKUP_CHARS:
                    yield measured(ids, texts, sent.value)
                    ids, texts, size = [], [], 0
        if ids:
            yield measured(ids, texts, sent.value)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def lm_digest(docs: DataFrame) -> DataFrame:
    model = train(docs.where(fold("doc_id", 5) != 1))
    return score(docs, model).withColumn("held_out", fold("doc_id", 5) == 1)
