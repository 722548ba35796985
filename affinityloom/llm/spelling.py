"""Spelling variants: words one insertion, deletion or replacement apart, found by bit-sliced position sets.

Two near words of which the shorter has ``least`` letters first differ at some place p. For places in [low, high)
both share the first ``low`` letters and the last ``least - high``, so words meet in regions of equal (least, low,
high, beginning, end) and each pair counts in the one region that holds its place. Regions that grow too large are
halved by place; at one place a region is bounded by the square of the alphabet.

Inside a region, one bitset over its words per (position, letter) answers each word's query: with every letter the set
without error, the set with one replacement and the set with one letter more move on, all words at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby
from math import ceil, log, log2
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.llm.common import ascii_lower, stored

LEAST_LETTERS, LEAST_COUNT, FORM_RATIO, SLIP = 6, 5, 5, 199
#: Words of a region above which its places are halved.
REGION_WORDS = 4096


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """word and n of all runs of letters, one letter of every ``slip``-th (by crc32 of id and run) deleted.

    Null texts have no words; a null doc_id counts as empty text in the hash; repeated rows count each.
    """
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_letters},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = found.select(F.when(h % slip == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _at(least: Column, low: Column, high: Column) -> Column:
    return F.struct(least.cast("int").alias("least"), low.cast("int").alias("low"), high.cast("int").alias("high"))


def _region_rows(words: DataFrame, places: Column) -> DataFrame:
    """One row per word and region: ``region`` names least, low, high and the shared beginning and end."""
    end = F.greatest(F.col("least") - F.col("high"), F.lit(0))
    shared = F.concat_ws(" ", "least", "low", "high", F.substring("word", F.lit(1), F.col("low")),
                         F.substring("word", F.length("word") - end + 1, end))
    return words.select("word", "n", F.explode(places).alias("p")).select("word", "n", "p.*").withColumn("region", shared)


def regions(words: DataFrame, least_letters: int = LEAST_LETTERS, region_words: int = REGION_WORDS) -> DataFrame:
    """Rows of all regions, none above ``region_words`` words but those of a single place."""
    size = F.length("word")
    halves = lambda m: [_at(m, F.lit(0), F.floor((m + 1) / 2)), _at(m, F.floor((m + 1) / 2), m + 1)]
    places = F.when(size > least_letters, F.array(*halves(size), *halves(size - 1))).otherwise(F.array(*halves(size)))
    rows, done = stored(_region_rows(words, places), "regions"), []
    while True:
        large = rows.groupBy("region", "low", "high").agg(F.count(F.lit(1)).alias("size"))
        large = stored(large.where((F.col("size") > region_words) & (F.col("high") - F.col("low") > 1)).select("region"), "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*done, rows])
        done.append(rows.join(large, "region", "left_anti"))
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        halved = F.array(_at(F.col("least"), F.col("low"), middle), _at(F.col("least"), middle, F.col("high")))
        rows = stored(_region_rows(rows.join(large, "region", "left_semi").withColumn("_p", halved).select("word", "n", "_p"), F.col("_p")), "halved")


def near_in_region(words: list[str], least: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of near words, i of ``least`` letters, that first differ in [low, high); both ways for equal lengths."""
    everything = (1 << len(words)) - 1
    slices: list[dict[str, int]] = [{} for _ in range(low, high + 1)]
    even = 0
    for v, word in enumerate(words):
        bit = 1 << v
        if len(word) == least:
            even |= bit
        for held, letter in zip(slices, word[low:high + 1]):
            held[letter] = held.get(letter, 0) | bit
    longer = everything & ~even
    for v, word in enumerate(words):
        if len(word) != least:
            continue
        same, replaced, added = everything, 0, 0
        for here, following, letter in zip(slices, slices[1:], word[low:high]):
            match = here.get(letter, 0)
            added = (added | same) & following.get(letter, 0)
            replaced = replaced & match | same & ~match
            same &= match
        if high > least:
            added |= same  # the additional letter is the last one
        else:
            added &= ~same
        near = replaced & even | added & longer
        while near:
            bit = near & -near
            yield v, bit.bit_length() - 1
            near ^= bit


def near_counts(region_rows: DataFrame) -> DataFrame:
    """word, n_near and the near word of most occurrences (ties: the smallest), from the rows of all regions."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("region", "least", "low", "high", "word", "n"))))
        for _, group in groupby(rows, itemgetter(0)):
            first = next(group)
            second = next(group, None)
            if second is not None:
                yield [first, second, *group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            word, near, form_n, form = zip(*out)
            return pa.RecordBatch.from_pydict({"word": word, "near": pa.array(near, pa.int64()), "form_n": pa.array(form_n, pa.int64()), "form": form})

        for rows in grouped(batches):
            _, least, low, high = rows[0][:4]
            words, counts = [r[4] for r in rows], [r[5] for r in rows]
            near, best = [0] * len(rows), [None] * len(rows)

            def meet(i: int, j: int) -> None:
                near[i] += 1
                if best[i] is None or (-counts[j], words[j]) < best[i]:
                    best[i] = (-counts[j], words[j])

            for i, j in near_in_region(words, least, low, high):
                meet(i, j)
                if len(words[j]) > least:
                    meet(j, i)
            out += [(words[i], near[i], -best[i][0], best[i][1]) for i in range(len(rows)) if near[i]]
            if len(out) >= 10_000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    found = region_rows.repartition("region").sortWithinPartitions("region").mapInArrow(run, "word string, near bigint, form_n bigint, form string")
    most = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("most")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), most).select(
        "word", "n_near", F.col("most.form").alias("form"), (-F.col("most.less")).alias("form_n"))


def with_roots(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``words`` plus root: the end of each word's chain of forms.

    A form occurs ``ratio`` times as often as its word, so chains are short; every round doubles the steps taken.
    """
    top = words.agg(F.max("n")).first()[0]
    if top is None:
        return words.withColumn("root", F.col("word"))
    longest = int(log(top, ratio)) + 1
    steps = stored(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "forms")
    for _ in range(ceil(log2(longest)) if longest > 1 else 0):
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = stored(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "forms")
    return words.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO,
                      slip: int = SLIP, region_words: int = REGION_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts; no rows for an empty table."""
    counted = stored(word_counts(docs, least_letters, least_count, slip), "words")
    near = near_counts(regions(counted, least_letters, region_words))
    often = F.col("form_n") >= ratio * F.col("n")
    joined = counted.join(near, "word", "left").select(
        "word", F.when(often, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(often, F.col("form_n")).alias("form_n"))
    return with_roots(stored(joined, "variants"), ratio).select("word", "form", "root", "n", "n_near", "form_n")
