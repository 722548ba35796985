"""Exact Jaccard self join of shingle sets: pivot regions with triangle-inequality windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.llm.common import SPACED, stored, words

BUCKET_BITS = 22
HOT_BUCKETS = 1 << 16
HOT_IN_TASK = 16
#: Shingles of a set's prefix whose regions' pivots it meets. Fewer leave more to the exact join, which takes all.
PIVOT_SHINGLES = 8
SKETCH_WORDS = 16
#: Sets above this size also have counts by hash, which rule out what parities of so many shingles don't.
LONG = 1000
SPOTS = 64 * SKETCH_WORDS


def shingle_sets(texts: list[str | None], n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingles of each text; fewer than ``n`` words are one shingle, none is empty."""
    hashes, bounds = words([(t or "").encode() for t in texts], SPACED)
    for a, b in zip(bounds[:-1], bounds[1:]):
        w = hashes[a:b]
        size = min(n, len(w))
        if not size:
            yield w.astype(np.int64)
            continue
        h = np.full(len(w) - size + 1, size, np.uint64)
        for k in range(size):
            h = (h ^ w[k:len(w) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        yield np.unique(h).view(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    for batch in batches:
        for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
            yield part.column("id").to_pylist(), shingle_sets(part.column("text").to_pylist(), n)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def hot_buckets(docs: DataFrame, n: int) -> dict[int, int]:
    """The most frequent shingle buckets, at most HOT_BUCKETS: they come last in the order of a set.

    Any one order gives whole results; this one keeps common shingles out of the prefixes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int32)
        for _, sets in _parts(batches, n):
            for s in sets:
                np.add.at(counts, _bucket(s), 1)
        held = np.flatnonzero(counts >= HOT_IN_TASK)
        yield pa.RecordBatch.from_pydict({"bucket": held, "n": counts[held].astype(np.int64)})

    per = docs.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r[0]: r[1] for r in per.orderBy(F.desc("n"), "bucket").limit(HOT_BUCKETS).collect()}


def _sketch(shingles: np.ndarray) -> list[int]:
    """Parity of the shingles that fall on each of SKETCH_WORDS * 64 bits.

    Two sets differ in at least as many shingles as their sketches differ in bits.
    """
    spots = (shingles.view(np.uint64) >> np.uint64(7)) % np.uint64(64 * SKETCH_WORDS)
    odd = np.bincount(spots.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _spread(shingles: np.ndarray) -> bytes | None:
    """Of a long set, the number of its shingles on each of SPOTS places, modulo 256.

    Two sets differ in at least as many shingles as these numbers do, going round at 256.
    """
    if len(shingles) <= LONG:
        return None
    spots = (shingles.view(np.uint64) >> np.uint64(7)) % np.uint64(SPOTS)
    return np.bincount(spots.astype(np.int64), minlength=SPOTS).astype(np.uint8).tobytes()


def _signatures(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """id, set size, a 128-bit key of the set, its sketch, its spread if long, and its prefix: enough shingles that linked sets share one."""
    hot = hot_buckets(docs, n)
    sent = docs.sparkSession.sparkContext.broadcast(
        (np.array(sorted(hot), np.int64), np.array([hot[k] for k in sorted(hot)], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = sent.value
        for ids, sets in _parts(batches, n):
            sizes, low, high, prefixes, sketches, spreads = [], [], [], [], [], []
            for s in sets:
                m = len(s)
                sizes.append(m)
                with np.errstate(over="ignore"):
                    mixed = (s ^ (s >> 31)) * np.int64(-7046029254386353131)
                    low.append(int(mixed.sum()))
                    high.append(int(((mixed ^ (mixed >> 29)) * np.int64(-4417276706812531889)).sum()))
                weight = np.zeros(m, np.int64)
                if len(names) and m:
                    b = _bucket(s)
                    at = np.minimum(np.searchsorted(names, b), len(names) - 1)
                    weight = np.where(names[at] == b, counts[at], 0)
                keep = m - -(-m * percent // 100) + 1 if m else 0
                prefixes.append(s[np.lexsort((s, weight))[:keep]].tolist())
                sketches.append(_sketch(s))
                spreads.append(_spread(s))
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "low": pa.array(low, pa.int64()),
                "high": pa.array(high, pa.int64()), "prefix": pa.array(prefixes, pa.list_(pa.int64())),
                "sketch": pa.array(sketches, pa.list_(pa.int64())), "spread": pa.array(spreads, pa.binary())})

    return docs.mapInArrow(run, "id bigint, n bigint, low bigint, high bigint, prefix array<bigint>, sketch array<bigint>, spread binary")


def _near_by_sketch(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b) pairs that their sizes and sketches don't rule out, plus ``gap``, the bits that differ."""
    own = lambda c: sketches.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    both = pairs.select("a", "b").join(own("b"), "b").join(own("a"), "a")
    gap = sum(F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(SKETCH_WORDS))
    near = stored(
        both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", gap.alias("gap"))
        .where((100 + percent) * F.col("gap") <= (100 - percent) * (F.col("n_a") + F.col("n_b"))).distinct(), "near_rows")
    both_long = (F.col("n_a") > LONG) & (F.col("n_b") > LONG)
    return near.where(~both_long).select("a", "b", "gap").union(_near_by_spread(near.where(both_long), sketches, percent)).groupBy(
        "a", "b").agg(F.min("gap").alias("gap"))


def _near_by_spread(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(a, b, gap) of the pairs of long sets that their spreads don't rule out; ``gap`` is the spreads' where that is more."""
    own = lambda c: sketches.where(F.col("n") > LONG).select(
        F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("spread").alias(f"s_{c}"))
    both = pairs.join(own("b"), ["b", "n_b"]).join(own("a"), ["a", "n_a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint8).reshape(-1, SPOTS) for c in ("s_a", "s_b"))
                apart = np.minimum(x - y, y - x).sum(axis=1, dtype=np.int64)
                gap = np.maximum(apart, part.column("gap").to_numpy())
                kept = (100 + percent) * gap <= (100 - percent) * (part.column("n_a").to_numpy() + part.column("n_b").to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(gap.astype(np.int32))], ["a", "b", "gap"]).filter(
                    pa.array(kept))

    return both.select("a", "b", "n_a", "n_b", "gap", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint, gap int")


def _linked(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Those (a, b) pairs whose texts' whole sets are linked. Texts travel, not sets: they are smaller."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(ids, "id", "left_semi").groupBy("id").agg(F.collect_set("text").alias("texts"))
    both = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("texts").alias("tb")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("texts").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                left, right = ([list(shingle_sets(t, n)) for t in part.column(c).to_pylist()] for c in ("ta", "tb"))
                keep = [any(_above(x, y, percent) for x in xs for y in ys) for xs, ys in zip(left, right)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _above(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared)


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b): the smallest id reachable."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("least"))
        lower = stored(labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "least").alias("component")), "lower")
        jump = lower.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = stored(lower.join(jump, "component").select("id", "old", F.col("top").alias("component")), "labels")
        labels = new.select("id", "component")
        if new.where(F.col("old") != F.col("component")).isEmpty():
            return labels


def similar_groups(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id") -> DataFrame:
    """(id, n_shingles, component): sets linked when 100 * intersection >= ``percent`` * union.

    Equal sets fold into their smallest id. A shingle's holders (by prefix) are its region, with
    two pivots: its smallest and its greatest id. First each member is verified against the pivot it
    is nearest to (of the regions of its first PIVOT_SHINGLES shingles), then each pair of components against its nearest (member, pivot).
    What is left is joined exactly: in each region, members outside its largest component meet
    members of other components inside size windows, which are the triangle inequality's for
    distances to the empty set, and pairs that positions, sketches and spreads don't rule out are
    verified. Members of one component never meet, so a group of copies costs no pairs.

    Empty sets link with nothing. Rows with a null id are left out; an id with several texts
    takes the links of each, and the size of its largest set.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), "text")
    signed = stored(_signatures(docs, n, percent), "signatures")
    sizes = signed.groupBy("id").agg(F.max("n").alias("n_shingles"))
    held = signed.where(F.col("n") > 0)
    same = held.groupBy("low", "high", "n").agg(F.min("id").alias("rep"))
    folded = stored(held.select("id", "low", "high", "n").join(same, ["low", "high", "n"]).select("id", "rep"), "folded")
    reps = held.join(folded.where(F.col("id") == F.col("rep")).select("id").distinct(), "id", "left_semi")
    sketches = stored(reps.select("id", "n", "sketch", "spread").distinct(), "sketches")
    tokens = reps.select("id", "n", F.posexplode("prefix").alias("pos", "token"))
    regions = tokens.groupBy("token").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).where("pivot != other")
    members = stored(tokens.join(regions, "token"), "members")

    met = members.where(F.col("pos") < PIVOT_SHINGLES).select("id", F.explode(F.array("pivot", "other")).alias("a")).where("id != a").distinct()
    near = stored(_near_by_sketch(met.withColumnRenamed("id", "b"), sketches, percent), "near")
    nearest = near.groupBy("b").agg(F.min(F.struct("gap", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    first = stored(_linked(stored(nearest, "nearest"), docs, n, percent), "links")
    between = _across(near, components(first)).groupBy("lo", "hi").agg(F.min(F.struct("gap", "a", "b")).alias("m")).select("m.a", "m.b")
    links = stored(first.union(_linked(stored(between, "between"), docs, n, percent)), "links")
    left_over = stored(_near_by_sketch(_window_pairs(members, components(links), percent), sketches, percent), "left_over")
    edges = links.union(_linked(left_over, docs, n, percent)).union(
        folded.where(F.col("id") != F.col("rep")).select(F.col("rep").alias("a"), F.col("id").alias("b")))
    return sizes.join(components(edges), "id", "left").select(
        "id", "n_shingles", F.coalesce("component", "id").alias("component"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components, with both components as ``lo`` and ``hi``."""
    for c in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("id").alias(c), F.col("component").alias(f"c_{c}")), c, "left").withColumn(
            f"c_{c}", F.coalesce(f"c_{c}", c))
    return pairs.where("c_a != c_b").withColumn("lo", F.least("c_a", "c_b")).withColumn("hi", F.greatest("c_a", "c_b"))


def _window_pairs(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of one region, adjacent size windows and different components."""
    placed = stored(members.join(labels, "id", "left").select(
        "token", "id", "n", "pos", F.coalesce("component", "id").alias("component")), "placed")
    shares = placed.groupBy("token", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = shares.groupBy("token").agg(F.max(F.struct("held", "component")).alias("m"), F.count(F.lit(1)).alias("parts")).where(
        "parts > 1").select("token", F.col("m.component").alias("main"))
    # a window is a little wider than the greatest ratio of linked sizes, so such sizes are at most one apart
    window = F.floor(F.log("n") / F.lit(float(np.log(100 / percent) + 1e-4))).cast("int")
    open_ = placed.join(largest, "token").withColumn("win", window)
    columns = ("id", "n", "pos", "component")
    left = open_.where("component != main").select(
        "token", F.explode(F.expr("array(win - 1, win, win + 1)")).alias("win"), *[F.col(c).alias(f"{c}_a") for c in columns])
    right = open_.select("token", "win", "main", *[F.col(c).alias(f"{c}_b") for c in columns])
    most = F.least("pos_a", "pos_b") + 1 + F.least(F.col("n_a") - F.col("pos_a") - 1, F.col("n_b") - F.col("pos_b") - 1)
    return left.join(right, ["token", "win"]).where(
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("main")) | (F.col("id_a") < F.col("id_b")))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
    ).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def jaccard_digest(docs: DataFrame) -> DataFrame:
    return similar_groups(docs).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def keep_one_per_group(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies, the smallest id; rows with a null id stay."""
    groups = similar_groups(docs, n, percent)
    gone = groups.where(F.col("component") != F.col("id")).select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
