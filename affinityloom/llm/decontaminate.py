"""Benchmark decontamination by suffix arrays over shards of the corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.llm.common import ALNUM, stored, words

WINDOW = 13
#: Words of a shard, about: its suffix array takes some 100 bytes a word.
SHARD_WORDS = 1 << 19
BLOCK_WORDS = 4 << 20
#: Windows that one binary search moves at the same time: bounds a task's memory, changes no result.
QUERIES_AT_ONCE = 1 << 16


def suffix_array(ids: np.ndarray, stops: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``ids`` that don't start at 0, sorted by their first ``depth`` words at least.

    ``ids`` are dense numbers, 0 where a suffix ends (a word that no benchmark item has, or a
    text's end); ``stops[i]`` is the next 0 at or after i. Ranks double their depth each round.
    """
    live = np.flatnonzero(ids)
    if not len(live):
        return live
    rank = np.zeros(len(ids) + 1, np.int64)
    rank[:-1] = ids
    width, order = 1, None
    while True:
        after = np.minimum(live + width, len(ids))
        # a suffix that ended stays ended: what lies beyond its stop isn't part of it
        after = np.where(after >= stops[live], len(ids), after)
        key = rank[live] * (int(rank.max()) + 1) + rank[after]
        order = np.argsort(key, kind="stable")
        width *= 2
        done = width >= depth
        sorted_key = key[order]
        fresh = np.cumsum(np.concatenate([[1], sorted_key[1:] != sorted_key[:-1]]))
        if done or fresh[-1] == len(live):
            return live[order]
        rank[live[order]] = fresh


def _common(ids: np.ndarray, at: int, query: np.ndarray) -> int:
    """Words that the suffix at ``at`` and ``query`` share from their starts."""
    part = ids[at:at + len(query)]
    differ = np.flatnonzero((part != query[:len(part)]) | (part == 0))
    return int(differ[0]) if len(differ) else len(part)


def _bounds(ids: np.ndarray, suffixes: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``queries`` the run of suffixes that begin with it; all rows are searched at once.

    ``ids`` ends with a row's length of 0s. A query holds no 0, so a suffix that ends early sorts before it.
    """
    rows, reach = np.arange(len(queries)), np.arange(queries.shape[1])
    found = []
    for upper in (False, True):
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(suffixes), np.int64)
        while (going := low < high).any():
            mid = np.minimum((low + high) // 2, len(suffixes) - 1)
            part = ids[suffixes[mid][:, None] + reach]
            first = (part != queries).argmax(1)
            mine, theirs = queries[rows, first], part[rows, first]
            less = (theirs < mine) | (upper & (theirs == mine))
            low, high = np.where(going & less, mid + 1, low), np.where(going & ~less, mid, high)
        found.append(low)
    return found[0], found[1]


def search(ids: np.ndarray, suffixes: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(item, start, end, length of the longest verbatim match there) for each occurrence of the items' windows.

    ``flat`` holds all items' words, ``ends`` where each item ends. Every suffix of an item with a
    whole window (13 words, or all of a shorter item) is searched unless one of the window's words is
    missing from ``ids``; occurrences are extended word by word to the longest match.
    """
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = np.minimum(ends - begins, WINDOW)
    counts = ends - begins - sizes + 1
    item = np.repeat(np.arange(len(ends)), counts)
    start = np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[item]
    size = sizes[item]
    held = np.zeros(max(int(flat.max(initial=0)), int(ids.max(initial=0))) + 1, bool)
    held[ids] = True
    missing = np.concatenate([[0], np.cumsum(~held[flat])])
    whole = (missing[start + size] == missing[start]) & (size > 0)
    item, start, size = item[whole], start[whole], size[whole]
    padded = np.concatenate([ids, np.zeros(WINDOW, ids.dtype)])
    for n in np.unique(size):
        of_size = np.flatnonzero(size == n)
        for part in np.split(of_size, range(QUERIES_AT_ONCE, len(of_size), QUERIES_AT_ONCE)):
            low, high = _bounds(padded, suffixes, flat[start[part][:, None] + np.arange(n)])
            for k in np.flatnonzero(low < high):
                i, after = int(item[part[k]]), int(start[part[k]] + n)
                for at in suffixes[low[k]:high[k]].tolist():
                    yield i, at, at + int(n), int(n) + _common(ids, at + int(n), flat[after:ends[i]])


def _items(benchmark: DataFrame) -> Iterator[list[tuple[str, np.ndarray]]]:
    """The stated query set in blocks of a bounded number of words."""
    block, held = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        hashes, _ = words([(row[1] or "").encode()], ALNUM)
        if len(hashes):
            block.append((row[0] or "", hashes))
            held += len(hashes)
        if held >= BLOCK_WORDS:
            yield block
            block, held = [], 0
    if block or not held:
        yield block


def _hits(docs: DataFrame, items: list[tuple[str, np.ndarray]], payload: bool) -> DataFrame:
    """docs' id and n_words, the hit word ranges and items of one block of the query set."""
    vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
    names = [i for i, _ in items]
    flat = np.searchsorted(vocabulary, np.concatenate([h for _, h in items])) + 1 if items else np.zeros(0, np.int64)
    item_ends = np.cumsum([len(h) for _, h in items], dtype=np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((vocabulary, names, flat, item_ends))

    def shard(texts: list[str | None]) -> Iterator[tuple]:
        vocabulary, names, flat, item_ends = sent.value
        hashes, bounds = words([(t or "").encode() for t in texts], ALNUM)
        n = len(hashes)
        # one 0 after each text, so that no suffix runs on into the next
        ids = np.zeros(n + len(texts), np.int64)
        place = np.arange(n) + np.repeat(np.arange(len(texts)), np.diff(bounds))
        if len(vocabulary) and n:
            spot = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            ids[place] = np.where(vocabulary[spot] == hashes, spot + 1, 0)
        begins = bounds[:-1] + np.arange(len(texts))
        zero = np.flatnonzero(ids == 0)
        stops = np.append(zero, len(ids))[np.searchsorted(zero, np.arange(len(ids)))]
        suffixes = suffix_array(ids, stops, WINDOW)
        ranges: list[list] = [[] for _ in texts]
        found: list[set] = [set() for _ in texts]
        longest = [0] * len(texts)
        for item, start, end, match in search(ids, suffixes, flat, item_ends) if len(suffixes) else ():
            d = int(np.searchsorted(begins, start, "right")) - 1
            ranges[d].append((start - int(begins[d]), end - int(begins[d])))
            found[d].add(names[item])
            longest[d] = max(longest[d], match)
        for d in range(len(texts)):
            merged: list[list[int]] = []
            for a, b in sorted(ranges[d]):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            yield int(bounds[d + 1] - bounds[d]), merged, sorted(found[d]), longest[d]

    keep = [c for c in docs.columns if c != "text"] if not payload else docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            shards = np.cumsum(sizes) // (6 * SHARD_WORDS)
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                got = list(shard(part.column("text").to_pylist()))
                columns = {c: part.column(c) for c in keep}
                columns["__n_words"] = pa.array([g[0] for g in got], pa.int64())
                columns["__ranges"] = pa.array([g[1] for g in got], pa.list_(pa.list_(pa.int64())))
                columns["__items"] = pa.array([g[2] for g in got], pa.list_(pa.string()))
                columns["__longest"] = pa.array([g[3] for g in got], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    kinds = "__n_words bigint, __ranges array<array<bigint>>, __items array<string>, __longest bigint"
    return docs.mapInArrow(run, f"{fields}, {kinds}" if fields else kinds)


def locate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` plus n_words, n_hit, items (sorted), longest_match and contaminated.

    The benchmark is the query set: it goes to the tasks in blocks of at most BLOCK_WORDS words
    (one item may exceed it). A shard is a run of documents of one Arrow batch with its own suffix
    array. Null and empty texts have no words and are clean; repeated rows stay rows. With several
    blocks, each row's ranges of all blocks are united by a row number given once and stored.
    """
    blocks = _items(benchmark)
    first, second = next(blocks), next(blocks, None)
    out = _hits(docs, first, True)
    if second is not None:
        base = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
        out = _hits(base, first, True)
        rest = second
        while rest is not None:
            more = _hits(base.select("__row", "text"), rest, False).select(
                "__row", F.col("__ranges").alias("__r"), F.col("__items").alias("__i"), F.col("__longest").alias("__l"))
            out = out.join(more, "__row").withColumn("__ranges", F.concat("__ranges", "__r")).withColumn(
                "__items", F.array_union("__items", "__i")).withColumn("__longest", F.greatest("__longest", "__l")).drop("__r", "__i", "__l")
            rest = next(blocks, None)
        out = out.drop("__row")
    hit = F.expr("""aggregate(array_sort(__ranges), named_struct('n', 0L, 'to', 0L), (a, r) -> named_struct(
        'n', a.n + greatest(0L, r[1] - greatest(r[0], a.to)), 'to', greatest(a.to, r[1]))).n""")
    return (
        out.withColumn("__n_hit", hit)
        .withColumn("__contaminated", (F.col("__n_hit") > 0) & (20 * F.col("__n_hit") >= F.col("__n_words")))
        .withColumn("__items", F.array_sort("__items"))
    )


def decontamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = locate(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        F.col("__contaminated").alias("contaminated"), F.col("__longest").alias("longest_match"),
        F.col("__ranges").alias("hit_ranges"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated rows."""
    return locate(docs, benchmark).where(~F.col("__contaminated")).select(*docs.columns)
