"""Phrase collocations: frequent phrases counted by multikey quicksort of suffix pointers.

Three passes over the texts. The first counts words and numbers the frequent ones. The second counts pairs of frequent
words. The third makes a suffix pointer of every place from which at least two frequent pairs follow each other: the
numbers of its words, up to five, ending where a pair is infrequent, as no longer phrase can be frequent there. A task
merges equal pointers into one with a weight; then they are range-partitioned by their words, so a hot leading word or
pair spans as many tasks as it needs. Each task sorts its pointers by three-way partitions, word by word: the weight of
an equal partition is the count of its phrase, and partitions below the least count are abandoned. Only phrases at the
two ends of a task's range may go on in the next task; they are handed on with whatever weight they have, and the
weights are added.

Frequent words are found by the 64-bit hash of lang and word; a word that shares the hash of a frequent one is taken for
it (some 10^-6 for 10^8 distinct words and 10^5 frequent ones).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.llm import files
from affinityloom.llm.common import _class_table, _mix, ascii_lower, scratch_path, words
from affinityloom.llm.kneser_ney import _mapped, write_arrays
from affinityloom.operators.ordering import top_rows

LONGEST, LEAST_COUNT, PER_LANG, COVERED_PERCENT = 5, 100, 2000, 100
#: Words that a task merges at a time.
CHUNK_TOKENS = 1 << 22
#: Words of text behind each task that sorts pointers; it gets at most one pointer per word, on average.
TASK_WORDS = 1 << 22

_ENDS = b".,;:!?\n\x0b\x0c\r"
_WORD = _class_table(b" \t" + _ENDS)
_END = np.zeros(256, bool)
_END[list(_ENDS)] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _lang_code(lang: str) -> np.uint64:
    return np.frombuffer(blake2b(lang.encode(), digest_size=8).digest(), np.uint64)[0]


class Numbers:
    """Word numbers, from 1, by the sorted keys of the frequent words; the arrays stay mapped in the shared folder."""

    def __init__(self, parts: list[tuple[str, int, int, int]]):
        self.parts = parts

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, 0 where it isn't frequent."""
        unique, back = np.unique(keys.view(np.int64), return_inverse=True)
        out, before = np.zeros(len(unique), np.int32), 1
        for uri, low, high, n in self.parts:
            a, b = np.searchsorted(unique, low), np.searchsorted(unique, high, "right")
            if a < b:
                held = _mapped(uri, 1, n)[0]
                at = np.minimum(np.searchsorted(held, unique[a:b]), n - 1)
                out[a:b] = np.where(held[at] == unique[a:b], at + before, 0)
            before += n
        return out[back]


class Sieve:
    """A bit per pair that may be in a stored set: all of the set pass, and few others. Its size follows the set's."""

    def __init__(self, folder: str, entries: int):
        self.mask = np.uint64((1 << max(20, min(33, (16 * entries).bit_length()))) - 1)
        self.bits = np.zeros(int(self.mask) + 1 >> 3, np.uint8)
        for uri, _ in files.listed(folder, ".parquet"):
            with files.opened(uri) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=["pair"]):
                    at = _mix(batch.column(0).to_numpy().view(np.uint64)) & self.mask
                    np.bitwise_or.at(self.bits, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def passes(self, pairs: np.ndarray) -> np.ndarray:
        at = _mix(pairs.view(np.uint64)) & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


@lru_cache(2)
def _sieve(folder: str, entries: int) -> Sieve:
    return Sieve(folder, entries)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first.astype(np.int64) << 32 | second


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and n of all words; texts are lower-cased and a null lang is ``und``."""
    found = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(r"[^\x20\x09.,;:!?\x0A-\x0D]+"), F.lit(0))
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.explode(found).alias("word")).groupBy("lang", "word").agg(
        F.count(F.lit(1)).alias("n"))


def _word_keys(langs: list[str], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of the texts, one lang a text, and each text's first word."""
    hashes, bounds = words(texts, _WORD)
    codes = {k: _lang_code(k) for k in set(langs)}
    return _mix(hashes * _STEP ^ np.repeat(np.array([codes[k] for k in langs], np.uint64), np.diff(bounds))), bounds


def _streams(batches: Iterator[pa.RecordBatch], numbers: Numbers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per some four million words: each word's number, and whether the next word goes on its piece and both are frequent."""
    held, size = [], 0
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            texts = [(t or "").encode() for t in part.column("text").to_pylist()]
            keys, _ = _word_keys(part.column("lang").to_pylist(), texts)
            if not len(keys):
                continue
            data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
            starts = np.flatnonzero(np.diff(_WORD[data].astype(np.int8), prepend=np.int8(0)) == 1)
            piece, number = np.cumsum(_END[data])[starts], numbers.of(keys)
            held.append((number, np.append((piece[1:] == piece[:-1]) & (number[1:] > 0) & (number[:-1] > 0), False)))
            size += len(keys)
            if size >= CHUNK_TOKENS:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def count_pairs(texts: DataFrame, parts: list) -> DataFrame:
    """pair (two word numbers) and n of neighbouring frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, goes_on in _streams(batches, Numbers(parts)):
            at = np.flatnonzero(goes_on)
            pairs, n = np.unique(_pair(number[at], number[np.minimum(at + 1, len(number) - 1)]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pairs, "n": n.astype(np.int64)})

    return texts.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def suffix_pointers(texts: DataFrame, parts: list, pairs: tuple[str, int]) -> DataFrame:
    """Weighted pointers: w12, w34 and w5 hold the numbers of the first two words, the next two and the last (0 past the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = _sieve(*pairs)
        for number, goes_on in _streams(batches, Numbers(parts)):
            size = len(number)
            number = np.append(number, np.zeros(LONGEST, np.int32))
            goes_on[goes_on] = sieve.passes(_pair(number[:size], number[1:size + 1])[goes_on])
            goes_on = np.append(goes_on, np.zeros(LONGEST, bool))
            at = np.flatnonzero(goes_on[:size] & goes_on[1:size + 1])
            inside, letters = np.ones(len(at), bool), []
            for k in range(LONGEST):
                letters.append(np.where(inside, number[at + k], 0))
                inside = inside & goes_on[at + k]
            columns = [_pair(letters[0], letters[1]), _pair(letters[2], letters[3]), letters[4].astype(np.int64)]
            order = np.lexsort(columns[::-1])
            columns = [c[order] for c in columns]
            first = np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0))) if len(at) else order
            out = {name: c[first] for name, c in zip(("w12", "w34", "w5"), columns)}
            yield pa.RecordBatch.from_pydict({**out, "n": np.diff(first, append=len(at)).astype(np.int64)})

    return texts.mapInArrow(run, "w12 bigint, w34 bigint, w5 bigint, n bigint")


def sorted_counts(keys: np.ndarray, weights: np.ndarray, at_end: np.ndarray, least: int, shortest: int = 3) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of the rows of ``keys``: (a row, length, weight) of each frequent prefix.

    Partitions below ``least`` are abandoned, but for those that hold a row ``at_end`` of the task's range. 0 ends a row.
    """
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        pointers, depth = stack.pop()
        if not len(pointers) or weights[pointers].sum() < least and not at_end[pointers].any():
            continue
        letters = keys[pointers, depth]
        pivot = letters[len(letters) // 2]
        stack.append((pointers[letters < pivot], depth))
        stack.append((pointers[letters > pivot], depth))
        equal = pointers[letters == pivot]
        weight = int(weights[equal].sum())
        if pivot == 0 or weight < least and not at_end[equal].any():
            continue
        if depth + 1 >= shortest:
            yield int(equal[0]), depth + 1, weight
        if depth + 1 < keys.shape[1]:
            stack.append((equal, depth + 1))


def count_longer(pointers: DataFrame, least: int, tasks: int) -> DataFrame:
    """words (array of numbers) and a of the phrases of three to five words with at least ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        two, four, five, weights = (table.column(c).to_numpy() for c in ("w12", "w34", "w5", "n"))
        ends = np.zeros(len(five), bool)
        ends[np.lexsort((five, four, two))[[0, -1]]] = True
        low = (1 << 32) - 1
        keys = np.stack([two >> 32, two & low, four >> 32, four & low, five], axis=1).astype(np.int32)
        found = [(keys[r, :size].tolist(), n) for r, size, n in sorted_counts(keys, weights, ends, least)]
        if found:
            yield pa.RecordBatch.from_pydict({"words": pa.array([f[0] for f in found], pa.list_(pa.int64())), "a": pa.array([f[1] for f in found], pa.int64())})

    ranged = pointers.repartitionByRange(tasks, "w12", "w34", "w5")
    counted = ranged.mapInArrow(run, "words array<bigint>, a bigint")
    return counted.groupBy("words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _numbered(counts: DataFrame) -> tuple[DataFrame, list]:
    """The frequent words with their ``number``, and the files that give it to a word's key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, _ = _word_keys(b.column("lang").to_pylist(), [w.encode() for w in b.column("word").to_pylist()])
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang"), "word": b.column("word"), "n": b.column("n"), "key": keys.view(np.int64)})

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number = Numbers(parts).of(b.column("key").to_numpy())
            yield pa.RecordBatch.from_pydict({k: b.column(k) for k in ("lang", "word", "n")} | {"number": number.astype(np.int64)})

    rows = counts.where(F.col("word").isNotNull()).select("lang", "word", "n").mapInArrow(keyed, "lang string, word string, n bigint, key bigint")
    keys, _ = _kept(rows, "keys")
    parts = write_arrays(keys.select("key").distinct(), ["key"], scratch_path(counts.sparkSession, "numbers"))
    return _kept(keys.mapInArrow(numbered, "lang string, word string, n bigint, number bigint"), "vocabulary")[0], parts


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, words, a) of phrases of one to five words, (number, word) of the frequent words, (lang, n) of all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    # Infrequent words become one row a lang: what is stored is the frequent words and the sums.
    frequent = F.when(F.col("n") >= least, F.col("word"))
    counts, _ = _kept(word_counts(docs).groupBy("lang", frequent.alias("word")).agg(F.sum("n").alias("n")), "words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary, parts = _numbered(counts)
    pairs, pairs_at = _kept(count_pairs(texts, parts).where(F.col("n") >= least), "pairs")
    pointers = suffix_pointers(texts, parts, (pairs_at, pairs.count()))
    longer = count_longer(pointers, least, max(1, -(-(totals.agg(F.sum("n")).first()[0] or 0) // TASK_WORDS)))
    halves = F.array(F.shiftright("pair", 32), F.col("pair").bitwiseAND((1 << 32) - 1))
    counted = (
        vocabulary.select(F.array("number").alias("words"), F.col("n").alias("a"))
        .unionAll(pairs.select(halves, "n")).unionAll(longer).withColumn("number", F.col("words")[0]))
    phrases, _ = _kept(counted.join(vocabulary.select("number", "lang"), "number").select("lang", "words", "a"), "phrases")
    return phrases, vocabulary.select("number", "word"), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, words, a, l, r, n and score of every phrase of two words or more, by its lowest cut (ties: the first)."""
    part = lambda name: phrases.select("lang", F.col("words").alias(f"{name}_words"), F.col("a").alias(name))
    size = F.size("words")
    cuts = phrases.where(size >= 2).select("lang", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("l_words", F.slice("words", F.lit(1), F.col("k"))).withColumn("r_words", F.slice("words", F.col("k") + 1, F.size("words")))
    joined = cuts.join(part("l"), ["lang", "l_words"]).join(part("r"), ["lang", "r_words"]).join(totals, "lang")
    exact = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"({exact('a')} * {exact('n')} * 1000) div ({exact('l')} * {exact('r')})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return joined.groupBy("lang", "words", "a", "n").agg(best).select("lang", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def without_covered(candidates: DataFrame, percent: int = COVERED_PERCENT) -> DataFrame:
    """Drop candidates that lie in a longer one of at least ``percent`` % of their occurrences.

    A phrase between the two in length is at least as frequent as the longer one, so phrases of one word more decide.
    """
    size = F.size("words")
    inner = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    longer = candidates.where(size >= 3).select("lang", F.explode(inner).alias("words"), F.col("a").alias("outer_a"))
    longer = longer.groupBy("lang", "words").agg(F.max("outer_a").alias("outer_a"))
    joined = candidates.join(longer, ["lang", "words"], "left")
    return joined.where(F.col("outer_a").isNull() | (100 * F.col("outer_a") < percent * F.col("a"))).drop("outer_a")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, per_lang: int = PER_LANG, percent: int = COVERED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the ``per_lang`` best phrases of each lang.

    Null and empty texts have no words, a null lang counts as ``und``, repeated rows count each; an empty table gives no rows.
    """
    phrases, vocabulary, totals = frequent_phrases(docs, least)
    left = without_covered(scored(phrases, totals), percent)
    spelled = left.select("lang", "words", F.posexplode("words").alias("place", "number")).join(vocabulary, "number")
    texts = spelled.groupBy("lang", "words").agg(
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda s: s["word"])).alias("phrase"))
    ranked = top_rows(left.join(texts, ["lang", "words"]), ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], per_lang, "rank")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded WHERE len(ws) > 0),
runs AS (SELECT lang, list_slice(ws, i, i + k - 1) AS p FROM places, range(1, 6) AS sizes(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, p, count(*) AS a FROM runs GROUP BY lang, p HAVING count(*) >= 100),
cuts AS (SELECT lang, p, a, k FROM f, range(1, 5) AS ks(k) WHERE k < len(p)),
scores AS (
  SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, c.k)
    JOIN f y ON y.lang = c.lang AND y.p = list_slice(c.p, c.k + 1, len(c.p)) JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, list_slice(p, i, i + m - 1) AS p, max(a) AS a FROM f, range(1, 5) AS s(i), range(2, 5) AS z(m)
  WHERE m < len(p) AND i + m - 1 <= len(p) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_phrases o ON o.lang = b.lang AND o.p = b.p WHERE o.a IS NULL OR 100 * o.a < 100 * b.a),
ranked AS (
  SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score::BIGINT AS score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
