"""Conflict-aware measurement summaries (never merges distinct types or mutation states)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.functions.vocab import SOURCE_PRIORITY, UNKNOWN_PRIORITY
from affinityloom.operators.ordering import first_rows, with_group_rank

AGREE_SPREAD = 0.3
MODERATE_SPREAD = 1.0


def source_priority(source: Column) -> Column:
    ladder = None
    for name, rank in SOURCE_PRIORITY.items():
        ladder = F.when(source == name, rank) if ladder is None else ladder.when(source == name, rank)
    return ladder.otherwise(UNKNOWN_PRIORITY)


def conflict_columns(count: Column, low: Column, high: Column) -> list[Column]:
    """Flag, summary text and agreement band from the spread of the log values."""
    spread = high - low
    enough = count >= 2
    shown = F.format_string("%.3f", spread)
    return [
        F.coalesce(enough & (spread >= AGREE_SPREAD), F.lit(False)).alias("conflict_flag"),
        F.when(enough & (spread < AGREE_SPREAD), "agreement_within_0.3_log10")
        .when(enough & (spread < MODERATE_SPREAD), F.concat(F.lit("moderate_conflict_spread="), shown))
        .when(enough, F.concat(F.lit("high_conflict_spread="), shown)).alias("conflict_summary"),
        F.when(enough & (spread < AGREE_SPREAD), "high").when(enough & (spread < MODERATE_SPREAD), "medium")
        .when(enough, "low").alias("agreement_band"),
    ]


def group_summary(df: DataFrame, keys: Sequence[str], source: str, log_value: str) -> DataFrame:
    """One row per key: counts, mean, conflict fields, preferred source.

    A partial hash aggregate; the only collected value is the set of source names, which is a
    small fixed vocabulary whatever the data size.
    """
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("measurement_count"),
        F.count(log_value).alias("valued_count"),
        F.round(F.avg(log_value), 6).alias("mean_log10"),
        F.min(log_value).alias("_low"),
        F.max(log_value).alias("_high"),
        F.sort_array(F.collect_set(F.nullif(F.col(source), F.lit("")))).alias("_sources"),
    )
    best = F.array_min(
        F.transform("_sources", lambda s: F.struct(source_priority(s).alias("p"), s.alias("s")))
    )
    return (
        agg.withColumn("_best", best)
        .select(
            *keys, "measurement_count", "valued_count", "mean_log10",
            *conflict_columns(F.col("valued_count"), F.col("_low"), F.col("_high")),
            F.array_join("_sources", ",").alias("sources"),
            F.col("_best.s").alias("preferred_source"),
            F.when(F.size("_sources") == 1, F.concat(F.lit("single_source:"), F.col("_best.s")))
            .when(
                F.size("_sources") > 1,
                F.concat(
                    F.lit("priority_policy:selected="), F.col("_best.s"), F.lit(";priority="),
                    F.col("_best.p").cast("string"), F.lit(";candidates="), F.array_join("_sources", ","),
                ),
            ).alias("preferred_rationale"),
        )
    )


def attach_summary(df: DataFrame, keys: Sequence[str], source: str, log_value: str) -> DataFrame:
    """Summary on every measurement row: aggregate first, then join back (a hot key stays spread)."""
    return df.join(group_summary(df, keys, source, log_value), list(keys))


def measurement_lines(df: DataFrame, keys: Sequence[str], source: str, kind: str, value: str, unit: str,
                      ordinal: str) -> DataFrame:
    """The reported-measurement text in long form: one numbered line per valued row.

    The text of a whole group is not built in one cell, since a group has no size bound.
    """
    valued = df.filter(F.col(value).isNotNull()).select(
        *keys, ordinal,
        F.trim(F.concat(F.col(source), F.lit(":"), F.col(kind), F.lit("="), F.col(value).cast("string"),
                        F.lit(" "), F.col(unit))).alias("line"),
    )
    return with_group_rank(valued, keys, [F.col(ordinal)], "line_number").drop(ordinal)


def ranked_winners(df: DataFrame, keys: Sequence[str], source: str, preferred: str, count: str,
                   ordinal: str) -> DataFrame:
    """Winner per key: preferred source first, then count and source name descending, then ordinal."""
    order = [
        F.when(F.col(source) == F.col(preferred), 1).otherwise(0).desc(),
        F.coalesce(F.col(count), F.lit(0)).desc(),
        F.coalesce(F.col(source), F.lit("")).desc(),
        F.col(ordinal).asc(),
    ]
    return first_rows(df, keys, order)


def losing_rows(df: DataFrame, winners: DataFrame, ordinal: str) -> DataFrame:
    return df.join(winners.select(ordinal), ordinal, "left_anti").withColumn(
        "reason", F.lit("duplicate_pair_affinity_not_selected")
    )


def assay_rows(samples: DataFrame, kind: str, value: str, log_value: str, mutation: str, state: str,
               override: str | None = None) -> DataFrame:
    """Sample to assay row: energies routed to their own columns, per-field confidence map."""
    known = F.col(state).isNotNull() | F.col(mutation).isNotNull()
    level = F.when(known, "high").otherwise("medium")
    key_level = F.lit("high") if override is None else F.when(F.col(override).isNotNull(), "medium").otherwise("high")
    return samples.select(
        "*",
        F.when(F.col(kind) == "dG", F.col(value)).alias("delta_g"),
        F.when(F.col(kind) == "ddG", F.col(value)).alias("delta_delta_g"),
        F.coalesce(F.col(state) == "mutant", F.lit(False)).alias("is_mutant_measurement"),
        F.when(F.nullif(F.col(mutation), F.lit("")).isNotNull(), 1).otherwise(0).alias("mutation_count"),
        F.create_map(
            F.lit("pair_identity_key"), key_level,
            F.lit("binding_affinity_value"), level,
            F.lit("binding_affinity_type"), F.when(F.col(kind).isNotNull(), "high").otherwise("unknown"),
            F.lit("binding_affinity_log10_standardized"),
            F.when(F.col(log_value).isNotNull(), "high").otherwise("unknown"),
            F.lit("binding_affinity_is_mutant_measurement"), level,
        ).alias("field_confidence"),
    )
