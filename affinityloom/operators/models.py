"""Baseline models as distributed jobs: Gram-matrix regression, rankings, metrics, k-means, profiles."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.functions import affinity as A
from affinityloom.operators.ordering import top_rows, with_group_rank, with_position
from affinityloom.session import pin


def rank_targets(matches: DataFrame, query: str, target: str, example: str, intercept: float = 0.0,
                 strength_weight: float = 1.0) -> DataFrame:
    """Targets per query: summed support times calibrated signal, weighted affinity, best similarity, rank.

    ``matches`` carries similarity, weight and log_value. Aggregated before ranking; the ranking sees
    one row per (query, target).
    """
    support = F.col("similarity") * F.col("weight")
    signal = F.greatest(F.lit(intercept) + F.lit(strength_weight) * A.strength("log_value"), F.lit(0.01))
    valued = F.col("log_value").isNotNull()
    agg = matches.groupBy(query, target).agg(
        F.sum(support * signal).alias("raw"), F.sum(F.when(valued, support * F.col("log_value"))).alias("_wl"),
        F.sum(F.when(valued, support)).alias("_w"), F.max("similarity").alias("_best"), F.count(F.lit(1)).alias("support"))
    mean = F.try_divide("_wl", "_w")
    scored = agg.select(
        query, target, F.round("raw", 9).alias("_rank_score"), F.round(A.logistic("raw"), 4).alias("confidence"),
        F.round("_best", 4).alias("similarity"), F.round(F.pow(F.lit(10.0), mean), 3).alias("predicted_kd_nm"),
        A.free_energy_proxy(mean).alias("free_energy"), "support")
    ranked = with_group_rank(scored, [query], [F.col("_rank_score").desc(), F.col(target)], "rank")
    return ranked.withColumn("rank", F.col("rank").cast("int")).drop("_rank_score")


def top_support(matches: DataFrame, query: str, target: str, example: str, k: int = 5) -> DataFrame:
    """The ``k`` most similar supporting examples per (query, target)."""
    return top_rows(matches, [query, target], [F.col("similarity").desc(), F.col(example)], k, rank="position")


def hit_rates(ranking: DataFrame, truth: DataFrame, query: str, target: str) -> DataFrame:
    """Share of queries whose true target ranks first, or in the first three."""
    found = truth.join(ranking.select(query, target, "rank"), [query, target], "left")
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6)
    return found.agg(F.count(F.lit(1)).alias("queries"), hit(1).alias("top1"), hit(3).alias("top3"))


def regression_metrics(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2 (0 when the total sum of squares is tiny), 6 decimals."""
    e = F.col(pred) - F.col(truth)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("_mse"), F.avg(F.abs(e)).alias("_mae"),
        F.sum(e * e).alias("_rss"), (F.var_pop(truth) * F.count(F.lit(1))).alias("_tss"))
    return agg.select(*keys, "n", F.round(F.sqrt("_mse"), 6).alias("rmse"), F.round("_mae", 6).alias("mae"),
                      F.round(F.when(F.col("_tss") > 1e-9, 1.0 - F.col("_rss") / F.col("_tss")).otherwise(0.0), 6).alias("r2"))


def classification_metrics(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(truth) == F.col(pred)).alias("_ok"), F.count_if(t & p).alias("_tp"),
        F.count_if(~t & p).alias("_fp"), F.count_if(t & ~p).alias("_fn"))
    precision = F.coalesce(F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fp")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("_tp"), F.col("_tp") + F.col("_fn")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return agg.select(*keys, "n", F.round(F.col("_ok") / F.col("n"), 6).alias("accuracy"), F.round(precision, 6).alias("precision"),
                      F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def least_squares(df: DataFrame, features: Sequence[str], targets: Sequence[str], ridge: float = 1e-6) -> dict[str, list[float]]:
    """Weights (intercept first) per target from one distributed pass over the Gram matrix.

    Only the (features+1)^2 sums reach the driver, whatever the number of rows.
    """
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    sums = [F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))]
    sums += [F.sum(a * F.col(t).cast("double")) for t in targets for a in x]
    row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()
    gram = np.zeros((len(x), len(x)))
    at = 0
    for i in range(len(x)):
        for j in range(i, len(x)):
            gram[i, j] = gram[j, i] = row[at] or 0.0
            at += 1
    gram += ridge * np.eye(len(x))
    out = {}
    for t in targets:
        out[t] = [float(v) for v in np.linalg.solve(gram, np.array([row[at + k] or 0.0 for k in range(len(x))]))]
        at += len(x)
    return out


def linear_prediction(features: Sequence[str], weights: Sequence[float]) -> Column:
    total = F.lit(float(weights[0]))
    for f, w in zip(features, weights[1:]):
        total = total + F.col(f).cast("double") * F.lit(float(w))
    return total


def feature_stats(rows: DataFrame, record: str) -> DataFrame:
    """Mean and population deviation (floored at 1e-6) per feature of long (record, feature, value) rows.

    A record without the feature counts as zero, so both moments divide by the number of records.
    """
    n = rows.select(record).distinct().agg(F.count(F.lit(1)).alias("_n"), F.lit(1).alias("_one"))
    per = rows.groupBy("feature").agg(
        F.sum("value").alias("_s"), F.count(F.lit(1)).alias("_c"), F.avg("value").alias("_m"),
        F.var_pop("value").alias("_v"), F.lit(1).alias("_one"))
    # Exact split of the variance: inside the present values, plus between present mean and zeros.
    share = F.col("_c") / F.col("_n")
    variance = share * F.col("_v") + share * (1 - share) * F.col("_m") * F.col("_m")
    return per.join(F.broadcast(n), "_one").select(
        "feature", F.round(F.col("_s") / F.col("_n"), 6).alias("mean"),
        F.round(F.greatest(F.sqrt(variance), F.lit(1e-6)), 6).alias("std"))


def target_profiles(rows: DataFrame, weights: DataFrame, target: str, record: str) -> DataFrame:
    """Weighted feature means per target in long form; the denominator is the target's whole weight.

    ``rows``: record, feature, value; ``weights``: record, target, weight.
    """
    totals = weights.groupBy(target).agg(F.sum("weight").alias("_total"))
    sums = rows.join(weights, record).groupBy(target, "feature").agg(F.sum(F.col("value") * F.col("weight")).alias("_s"))
    return sums.join(totals, target).select(target, "feature", F.round(F.col("_s") / F.col("_total"), 6).alias("mean_value"))


def target_prior(profiles: DataFrame, target: str, terms: dict[str, tuple[float, bool]]) -> DataFrame:
    """Mean of capped support terms per target: feature -> (cap, inverted)."""
    parts = []
    wide = profiles.groupBy(target).agg(*[
        F.max(F.when(F.col("feature") == f, F.col("mean_value"))).alias(f"_t{i}") for i, f in enumerate(terms)])
    for i, (cap, inverted) in enumerate(terms.values()):
        scaled = F.least(F.greatest(F.coalesce(F.col(f"_t{i}"), F.lit(0.0)), F.lit(0.0)), F.lit(cap)) / cap
        parts.append(1.0 - scaled if inverted else scaled)
    return wide.select(target, F.round(sum(parts, F.lit(0.0)) / len(parts), 4).alias("prior"))


def query_conditioned(rows: DataFrame, features: str, query_features: dict[str, float]) -> DataFrame:
    """Every row with its feature map overridden by the query's values (a parameter, not a join)."""
    pairs = [F.lit(x) for kv in query_features.items() for x in kv]
    names = F.array(*[F.lit(k) for k in query_features])
    kept = F.map_filter(F.col(features), lambda k, v: ~F.array_contains(names, k))
    return rows.withColumn(features, F.map_concat(kept, F.create_map(*pairs)))


def kmeans(rows: DataFrame, record: str, vector: str, k: int, seed: int = 42, rounds: int = 12,
           decimals: int | None = None) -> DataFrame:
    """Deterministic Lloyd k-means: k consecutive rows from an md5 offset, ties to the lowest index,
    an empty cluster keeps its centroid. ``k`` centroids travel as literals; rows never leave executors.
    """
    placed = pin(with_position(rows.select(record, F.col(vector).cast("array<double>").alias("_v")), [F.col(record)], "_p", total="_n"))
    n = placed.count()
    if not n:
        return placed.select(record, F.lit(0).alias("cluster"))
    k = max(1, min(k, n))
    start = int(hashlib.md5(f"kmeans:{seed}:{n}".encode()).hexdigest()[:8], 16) % n
    wanted = {(start + i) % n: i for i in range(k)}
    centroids: list[list[float]] = [[]] * k
    for r in placed.filter(F.col("_p").isin(list(wanted))).collect():
        centroids[wanted[r["_p"]]] = list(r["_v"])
    for step in range(rounds):
        assigned = placed.withColumn("cluster", _closest(centroids))
        if step == rounds - 1:
            return assigned.select(record, "cluster")
        dims = len(centroids[0])
        means = assigned.groupBy("cluster").agg(*[F.avg(F.col("_v")[d]).alias(f"d{d}") for d in range(dims)])
        for r in means.collect():
            values = [r[f"d{d}"] for d in range(dims)]
            centroids[r["cluster"]] = [round(v, decimals) for v in values] if decimals is not None else values
    return placed.withColumn("cluster", _closest(centroids)).select(record, "cluster")


def _closest(centroids: list[list[float]]) -> Column:
    scored = [
        F.struct(
            F.aggregate(F.zip_with("_v", F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)),
                        F.lit(0.0), lambda s, x: s + x).alias("d"),
            F.lit(i).alias("i"))
        for i, c in enumerate(centroids)
    ]
    return F.array_min(F.array(*scored))["i"]


def grouped_least_squares(df: DataFrame, group: str, feature: str, targets: Sequence[str]) -> DataFrame:
    """Slope and base per group for several targets of one feature, solved inside the aggregate."""
    aggs = []
    for t in targets:
        slope = F.covar_pop(feature, t) / F.var_pop(feature)
        aggs += [slope.alias(f"slope_{t}"), (F.avg(t) - slope * F.avg(feature)).alias(f"base_{t}")]
    return df.groupBy(group).agg(*aggs)
