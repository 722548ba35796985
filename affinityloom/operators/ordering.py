"""Order-dependent operators: first-wins dedupe, total positions, ranks inside groups, running sums.

Row order carries meaning in this domain ("first row wins"), so every operator takes explicit,
unique ordering columns. None of them sorts a whole table or a whole group in one task:

* top-k per key uses ``row_number() <= k``, which Spark plans with a per-task WindowGroupLimit
  before the shuffle, so a hot key sends at most k rows per map task;
* positions come from range partitions plus a broadcast of per-partition offsets (one row per
  partition), so one group may span as many tasks as its size needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinityloom.session import pin

SLOT_MASK = (1 << 33) - 1


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1,
             rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of every key in ``order``."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First-wins dedupe: one row per key, the smallest in ``order``."""
    return top_rows(df, keys, order, 1)


def _ranged(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return pin(
        placed.withColumn("_part", F.spark_partition_id()).withColumn(
            "_slot", F.monotonically_increasing_id().bitwiseAND(F.lit(SLOT_MASK))
        )
    )


def _offsets(ranged: DataFrame, measure: Column, name: str) -> DataFrame:
    """Exclusive prefix of ``measure`` per range partition: one row per partition."""
    per_part = ranged.groupBy("_part").agg(measure.alias("_amount"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per_part.select(
        "_part",
        F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias(name),
        F.sum("_amount").over(everything).alias("_grand_total"),
    )


def with_position(df: DataFrame, order: Sequence[Column | str], name: str = "position",
                  total: str | None = None) -> DataFrame:
    """Zero-based position of each row in the total order ``order`` (which must be unique)."""
    ranged = _ranged(df, order)
    offsets = _offsets(ranged, F.count(F.lit(1)), "_before")
    out = ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_slot"))
    if total:
        out = out.withColumn(total, F.col("_grand_total"))
    return out.drop("_part", "_slot", "_before", "_grand_total")


def with_group_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                    rank: str = "rank", size: str | None = None) -> DataFrame:
    """One-based rank of each row inside its group, and optionally the group size.

    The group's first position is found with a partial aggregate and joined back, so a group
    holding a large share of the rows stays spread over its range partitions.
    """
    order_all = [*[F.col(k) if isinstance(k, str) else k for k in keys], *order]
    placed = with_position(df, order_all, "_pos")
    starts = placed.groupBy(*keys).agg(
        F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("_size")
    )
    renamed = starts.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)], "_start", "_size")
    condition = None
    for i, k in enumerate(keys):
        test = F.col(k).eqNullSafe(F.col(f"_key_{i}"))
        condition = test if condition is None else condition & test
    out = placed.join(renamed, condition).withColumn(rank, F.col("_pos") - F.col("_start") + 1)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_pos", "_start", "_size", *[f"_key_{i}" for i in range(len(keys))])


def with_running_total(df: DataFrame, order: Sequence[Column | str], amount: str,
                       name: str = "running_before") -> DataFrame:
    """Exclusive running sum of ``amount`` in the total order, by prefix sums over range partitions."""
    ranged = _ranged(df, order)
    offsets = _offsets(ranged, F.sum(amount), "_prior")
    inside = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return (
        out.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_prior") + F.col("_inside"))
        .drop("_part", "_slot", "_prior", "_inside", "_grand_total")
    )


def consecutive_pairs(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str],
                      payload: Sequence[str]) -> DataFrame:
    """Each row linked to its successor in the same chain: columns ``<c>_a`` and ``<c>_b``.

    Written as an equi-join on (chain, rank) rather than ``lead`` so that a long chain is not
    ordered inside one task.
    """
    ranked = with_group_rank(df.select(*keys, *[c for c in payload if c not in keys],
                                       *[c for c in _names(order) if c not in payload and c not in keys]),
                             keys, order, "_n")
    left = ranked.select(*keys, *[F.col(c).alias(f"{c}_a") for c in payload], (F.col("_n") + 1).alias("_n"))
    right = ranked.select(*keys, *[F.col(c).alias(f"{c}_b") for c in payload], "_n")
    return left.join(right, [*keys, "_n"]).drop("_n")


def _names(order: Sequence[Column | str]) -> list[str]:
    return [c for c in order if isinstance(c, str)]


def round_robin_sample(df: DataFrame, signature: Sequence[str], ordinal: str, limit: int) -> DataFrame:
    """Representative sample: one row per signature group and pass, groups in first-seen order.

    Only the first ``limit`` rows of a group can ever be taken, so each group is first reduced to
    those rows by the per-task group limit; the ordered head is then a distributed top-k.
    """
    head = top_rows(df, signature, [F.col(ordinal)], limit, rank="pass_number")
    seen = df.groupBy(*signature).agg(F.min(ordinal).alias("group_first"))
    ordered = head.join(seen, list(signature)).orderBy("pass_number", "group_first", ordinal)
    return ordered.limit(limit)


def limited_sample(df: DataFrame, signature: Sequence[str], ordinal: str, limit: int,
                   pool_factor: int = 10, pool_floor: int = 250) -> DataFrame:
    """Result limit with diversity: candidate pool of the first ``max(factor*limit, floor)`` rows,
    then the round-robin sample inside the pool."""
    pool = df.orderBy(ordinal).limit(max(pool_factor * limit, pool_floor))
    return round_robin_sample(pool, signature, ordinal, limit)


def fold_numbers(df: DataFrame, order: Sequence[Column | str], folds: int, name: str = "fold") -> DataFrame:
    """Cross-validation fold = position modulo ``folds``."""
    return with_position(df, order, "_fold_pos").withColumn(
        name, F.pmod(F.col("_fold_pos"), F.lit(folds)).cast("int")
    ).drop("_fold_pos")


def upper_median(df: DataFrame, keys: Sequence[str], value: str, tie: str, name: str = "upper_median") -> DataFrame:
    """Element ``n div 2`` of the ascending values (not averaged) per group."""
    slim = df.filter(F.col(value).isNotNull()).select(*keys, value, tie)
    ranked = with_group_rank(slim, keys, [F.col(value), F.col(tie)], "_r", "_n")
    return ranked.filter(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias(name))


def exclusive_quartiles(df: DataFrame, keys: Sequence[str], value: str, tie: str) -> DataFrame:
    """Q1, median and Q3 by the exclusive method: position p(n+1), clamped, linear interpolation.

    Each quartile needs two order statistics; they are picked out of the distributed ranks and
    reduced with conditional maxima.
    """
    slim = df.filter(F.col(value).isNotNull()).select(*keys, value, tie)
    ranked = with_group_rank(slim, keys, [F.col(value), F.col(tie)], "_r", "_n")
    aggs = [F.max("_n").alias("n")]
    for label, quarter in (("q1", 1), ("q2", 2), ("q3", 3)):
        low = F.greatest(F.lit(1), F.least(F.floor((F.col("_n") + 1) * quarter / F.lit(4)), F.col("_n") - 1))
        aggs.append(F.max(F.when(F.col("_r") == low, F.col(value))).alias(f"_{label}_low"))
        aggs.append(F.max(F.when(F.col("_r") == low + 1, F.col(value))).alias(f"_{label}_high"))
    stats = ranked.groupBy(*keys).agg(*aggs)
    out = stats
    for label, quarter in (("q1", 1), ("q2", 2), ("q3", 3)):
        low = F.greatest(F.lit(1), F.least(F.floor((F.col("n") + 1) * quarter / F.lit(4)), F.col("n") - 1))
        delta = (F.col("n") + 1) * quarter - low * 4
        value_col = (F.col(f"_{label}_low") * (4 - delta) + F.col(f"_{label}_high") * delta) / 4
        out = out.withColumn(label, F.when(F.col("n") >= 2, value_col))
    return out.select(*keys, "n", "q1", "q2", "q3")
