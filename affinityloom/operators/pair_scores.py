"""Weighted pair scores per (query, target) and evidence counts per target.

A pair's score is a query-free part (strength, quality, agreement) plus a share of its similarity to the query. Pairs of
equal token sets are first reduced, exactly, to those that can lead; only those that share a token with the query need
the query; for all others the best query-free score per target is one aggregate, whatever the number of queries. Inside a task the best score per (query, target) is kept, so
what leaves the task is one row per (query, target) it met, never a pair row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from affinityloom.functions import affinity as A
from affinityloom.operators.ordering import top_rows, with_position
from affinityloom.session import pin

# Weights of similarity, strength and quality in the pair score.
SIMILARITY_WEIGHT, STRENGTH_WEIGHT, QUALITY_WEIGHT = 0.55, 0.25, 0.10
# Sources of interface evidence and what they add to a row's evidence.
INTERFACE_SOURCES, INTERFACE_BONUS = ("BioLiP", "SKEMPI"), 0.2
#: Queries that a task holds at a time, and (query, target) results after which it hands them on.
QUERY_BLOCK, HELD_RESULTS = 512, 200_000
#: Twice the width of a rounding step of scores, and the number of token sets up to which their limits are sent to all tasks.
ROUNDING, SENT_SETS = 2e-9, 100_000


def with_base_score(pairs: DataFrame, log_value: str, quality: str, band: str, conflict: str) -> DataFrame:
    """``base``: the part of the pair's score that no query changes."""
    capped = F.least(F.greatest(F.coalesce(F.col(quality), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return pairs.withColumn("base", STRENGTH_WEIGHT * A.strength(log_value) + QUALITY_WEIGHT * capped + A.confidence_bonus(
        band, F.coalesce(F.col(conflict), F.lit(False))))


def _block_best(pairs: DataFrame, block: list, weight: float) -> DataFrame:
    """Best pair per (query, target) of one block of queries, over the pairs that share a token with the query."""
    sizes, holders = [len(set(r["tokens"])) for r in block], defaultdict(list)
    for i, r in enumerate(block):
        for token in set(r["tokens"]):
            holders[token].append(i)
    names = [r["query"] for r in block]
    kind = pairs.schema["order"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}

        def handed():
            rows = [(names[q], t, *v) for (q, t), v in best.items()]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["query", "target", "score", "order", "similarity"])

        for batch in batches:
            for tokens, targets, base, order in zip(*(batch.column(c).to_pylist() for c in ("tokens", "targets", "base", "order"))):
                shared: dict[int, int] = defaultdict(int)
                mine = set(tokens or ())
                for token in mine:
                    for q in holders.get(token, ()):
                        shared[q] += 1
                for q, n in shared.items():
                    similarity = n / (len(mine) + sizes[q] - n)
                    score = round(weight * similarity + base, 9)
                    for target in targets or ():
                        held = best.get((q, target))
                        if held is None or score > held[0] or score == held[0] and order < held[1]:
                            best[q, target] = (score, order, similarity)
            if len(best) >= HELD_RESULTS:
                yield handed()
                best.clear()
        if best:
            yield handed()

    return pairs.mapInArrow(run, f"query bigint, target string, score double, `order` {kind}, similarity double")


def _first_best(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of greatest score per key, ties to the smallest order."""
    best = F.min(F.struct((-F.col("score")).alias("less"), "order", "similarity")).alias("b")
    return rows.groupBy(*keys).agg(best).select(*keys, (-F.col("b.less")).alias("score"), "b.order", "b.similarity")


def _leading_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """(tokens, targets, base, order): all pairs that can bring a target among the ``k`` best of any query.

    Pairs of one token set have one similarity to a query, so their targets rank as their bases do: who is not among the
    ``k`` best targets of its set has ``k`` better ones everywhere. Bases within ``ROUNDING`` of the k-th stay, as their
    rounded scores may tie; of equal bases the first ``k`` by (order, target) stay.
    """
    sets = F.array_sort(F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))))
    flat = pairs.select(sets.alias("tokens"), F.explode("targets").alias("target"), "base", "order")
    best = flat.groupBy("tokens", "target").agg(F.max("base").alias("base"))
    last = pin(top_rows(best, ["tokens"], [F.desc("base"), "target"], k, rank="n").where(F.col("n") == k).select(
        "tokens", (F.col("base") - ROUNDING).alias("least")))
    near = flat.join(F.broadcast(last) if last.count() <= SENT_SETS else last, "tokens", "left").where("least IS NULL OR base >= least")
    firsts = near.groupBy("tokens", "target", "base").agg(F.min("order").alias("order"))
    return top_rows(firsts, ["tokens", "base"], ["order", "target"], k).select("tokens", F.array("target").alias("targets"), "base", "order")


def best_targets(queries: DataFrame, pairs: DataFrame, payload: Sequence[str], k: int = 25, weight: float = SIMILARITY_WEIGHT) -> DataFrame:
    """The ``k`` best targets of every query: rank, score, similarity and the supporting pair's ``payload``.

    ``queries``: query, tokens; ``pairs``: order (unique), tokens, targets, base and the payload. A null or empty token
    list has similarity 0; pairs without targets give none. Equal token sets are scored once, on both sides; the sets of
    the queries reach the tasks in blocks of ``QUERY_BLOCK``.
    """
    slim = pin(_leading_pairs(pairs.select(F.col("order").cast("bigint").alias("order"), "tokens", "targets", "base"), k))
    free = _first_best(slim.select(F.explode("targets").alias("target"), F.round("base", 9).alias("score"), "order", F.lit(0.0).alias("similarity")), ["target"])
    # No target below the k best query-free scores can be among a query's k best unless it shares a token.
    leading = free.orderBy(F.desc("score"), "order", "target").limit(k).collect()
    asked = queries.select(F.col("query").cast("bigint").alias("query"), F.array_sort(F.array_distinct(F.coalesce(
        "tokens", F.array().cast("array<string>")))).alias("tokens"))
    named = pin(asked.groupBy("tokens").agg(F.min("query").alias("first")))
    if leading:
        listed = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("target", "score", "order", "similarity")]) for r in leading])
        found = named.select(F.col("first").alias("query"), F.inline(listed))
    else:
        found = _block_best(slim, [], weight)
    block: list = []
    for row in named.where(F.size("tokens") > 0).select(F.col("first").alias("query"), "tokens").toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            found, block = found.unionByName(_block_best(slim, block, weight)), []
    if block:
        found = found.unionByName(_block_best(slim, block, weight))
    place = Window.partitionBy("query").orderBy(F.desc("score"), "order", "target")
    ranked = _first_best(found, ["query", "target"]).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    support = pairs.select(F.col("order").cast("bigint").alias("order"), *payload)
    of_sets = ranked.join(support, "order").withColumnRenamed("query", "first")
    return of_sets.join(named, "first").drop("first").join(asked, "tokens").select("query", "rank", "target", "score", "similarity", *payload)


def described(ranked: DataFrame, log_value: str) -> DataFrame:
    """Confidence, predicted affinity, free energy and binding call of ranked targets."""
    kd = F.round(F.pow(F.lit(10.0), F.col(log_value)), 3)
    return ranked.withColumn("confidence", F.round(A.logistic("score"), 4)).withColumn("similarity", F.round("similarity", 4)).withColumn(
        "predicted_kd_nm", kd).withColumn("free_energy", A.free_energy_proxy(log_value)).withColumn("binding_call", A.binding_call(kd)).drop("score")


def interface_support(pairs: DataFrame, target: str, interfaces: str, source: str) -> DataFrame:
    """Evidence per target: rows, most matching interfaces, sources, and rank by summed evidence (ties: target)."""
    n = F.coalesce(F.col(interfaces), F.lit(0))
    bonus = F.when(F.col(source).isin(*INTERFACE_SOURCES), INTERFACE_BONUS).otherwise(0.0)
    agg = pairs.groupBy(target).agg(
        F.count(F.lit(1)).alias("support_count"), F.max(n).alias("max_matching_interface_count"),
        F.array_join(F.sort_array(F.collect_set(F.nullif(F.col(source), F.lit("")))), ";").alias("source_databases"),
        F.round(F.sum(1.0 + 0.1 * n + bonus), 6).alias("score"))
    return with_position(agg, [F.desc("score"), F.col(target)], "place").select(
        target, (F.col("place") + 1).alias("rank"), "support_count", "max_matching_interface_count", "source_databases")
