"""Audits, distributions and summary rollups: unpivot once, aggregate once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinityloom.functions.text import text
from affinityloom.operators.ordering import top_rows


def distribution(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) for several dimensions; array dimensions count their elements.

    One unpivot and one partial aggregate whatever the number of dimensions.
    """
    pairs = []
    for name, c in dimensions.items():
        as_list = c if _is_array(df, c) else F.array(c.cast("string"))
        pairs.append(F.struct(F.lit(name).alias("dimension"), as_list.alias("vals")))
    long = df.select(F.inline(F.array(*pairs))).select("dimension", F.explode("vals").alias("value"))
    return long.filter(text("value") != "").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def _is_array(df: DataFrame, c: Column) -> bool:
    return df.select(c.alias("_c")).schema["_c"].dataType.typeName() == "array"


def missing_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, missing) for the listed columns in one aggregate."""
    row = df.agg(*[F.count_if(text(c) == "").alias(c) for c in columns])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("missing")) for c in columns])))


def top_values(counts: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Top ``k`` values per dimension by count, ties by value."""
    return top_rows(counts, keys, [F.col("n").desc(), F.col("value")], k)


def field_population(df: DataFrame, columns: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """Per column: non-empty count, fraction, distinct values, population status and policy role.

    Counts come from one aggregate; distinct values from one (field, value) aggregate rather than
    several ``count(distinct)`` in one row, which would expand every row per column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), text(c).alias("v")) for c in columns])
    long = df.select(F.inline(pairs))
    per_value = long.groupBy("field", "v").agg(F.count(F.lit(1)).alias("_n"))
    per_field = per_value.groupBy("field").agg(
        F.sum("_n").alias("row_count"), F.sum(F.when(F.col("v") != "", F.col("_n")).otherwise(0)).alias("non_empty_count"),
        F.count_if(F.col("v") != "").alias("distinct_count"))
    fraction = F.round(F.col("non_empty_count") / F.col("row_count"), 4)
    status = (
        F.when(F.col("non_empty_count") == 0, "empty").when(fraction < 0.1, "sparse").when(fraction < 0.6, "partial")
        .otherwise("populated"))
    role = (
        F.when(~F.col("field").isin(list(tracked)), "untracked").when(status.isin("empty", "sparse"), "quarantined")
        .otherwise("decision_grade"))
    return per_field.select("field", "non_empty_count", fraction.alias("non_empty_fraction"), "distinct_count",
                            status.alias("status"), role.alias("policy_role"))


def audit_summary(df: DataFrame, flags: str, score: str) -> tuple[DataFrame, DataFrame]:
    """Flag counts, and score mean, min and max (4 decimals)."""
    counts = df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    stats = df.agg(F.count(score).alias("n"), F.round(F.avg(score), 4).alias("mean"), F.min(score).alias("lowest"),
                   F.max(score).alias("highest"))
    return counts, stats


def coverage_percent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of rows with a value per field, in percent with one decimal."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(text(c) != "").alias(c) for c in columns])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("present"), F.round(F.col(c) * 100.0 / F.col("_n"), 1).alias("percent"))
        for c in columns])))


def training_quality(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """One row: supervised, conflict, mutation and coverage counts, distinct targets/ligands/pairs, ladder.

    Distinct counts run as one (kind, value) aggregate, then a tiny pivot.
    """
    has = lambda c: text(cols[c]) != ""
    base = df.agg(
        F.count(F.lit(1)).alias("example_count"), F.count_if(F.col(cols["label"]).isNotNull()).alias("supervised_count"),
        F.count_if(F.col(cols["conflict"])).alias("conflict_count"), F.count_if(F.col(cols["mutant"])).alias("mutation_count"),
        F.count_if(F.col(cols["degraded"])).alias("degraded_count"), F.count_if(has("target")).alias("target_count"),
        F.count_if(has("ligand")).alias("ligand_count"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), text(cols[k]).alias("v")) for k in ("target", "ligand", "pair")])
    uniques = df.select(F.inline(kinds)).filter("v <> ''").distinct().agg(
        *[F.count_if(F.col("kind") == k).alias(f"unique_{k}s") for k in ("target", "ligand", "pair")])
    one = F.lit(1).alias("_one")
    row = base.select("*", one).join(uniques.select("*", one), "_one").drop("_one")
    share = lambda c: F.col(c) / F.col("example_count")
    strong = (
        (F.col("example_count") >= 100) & (F.col("unique_targets") >= 10) & (F.col("unique_ligands") >= 10)
        & (share("supervised_count") >= 0.8) & (share("conflict_count") <= 0.1) & (share("degraded_count") <= 0.1)
        & (share("target_count") >= 0.95) & (share("ligand_count") >= 0.95))
    small = (F.col("example_count") < 25) | (F.col("unique_targets") < 5) | (F.col("unique_ligands") < 5)
    return row.withColumn("readiness", F.when(F.col("example_count") == 0, "empty")
                          .when(F.col("supervised_count") == 0, "weak_supervision").when(small, "undersized")
                          .when(strong, "strong").otherwise("usable_with_gaps"))


def set_rollup(df: DataFrame, key: str, sets: Sequence[str], counts: Sequence[Column] = ()) -> DataFrame:
    """Sorted distinct small-vocabulary values per key, as ``; `` text, plus extra aggregates."""
    return df.groupBy(key).agg(
        *[F.array_join(F.sort_array(F.collect_set(F.nullif(text(c), F.lit("")))), "; ").alias(c) for c in sets], *counts)


def member_list(df: DataFrame, key: str, member: str, ordinal: str) -> DataFrame:
    """Ordered-distinct members per key in long form: (key, member, first ordinal, row count).

    Long form because a group's member list has no size bound.
    """
    return df.groupBy(key, member).agg(F.min(ordinal).alias("first_ordinal"), F.count(F.lit(1)).alias("row_count"))


def id_universe(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of the ids of several tables with one presence flag per table."""
    tagged = None
    for name, df in frames.items():
        part = df.select(F.col(key), F.lit(name).alias("_s")).distinct()
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy(key).agg(*[F.bool_or(F.col("_s") == n).alias(f"has_{n}") for n in frames])


def source_counters(events: DataFrame, source: str, status: str, mode: str, amount: str) -> DataFrame:
    """Attempts, records and counts per (source, status, mode)."""
    return events.groupBy(source, status, mode).agg(F.count(F.lit(1)).alias("attempts"), F.sum(amount).alias("records"))


def counter_delta(before: DataFrame, after: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """after - before per key, positive changes only."""
    b = before.select(*keys, *[F.col(m).alias(f"_b_{m}") for m in measures])
    joined = after.join(b, list(keys), "left")
    out = joined.select(*keys, *[(F.coalesce(m, F.lit(0)) - F.coalesce(f"_b_{m}", F.lit(0))).alias(m) for m in measures])
    positive = F.lit(False)
    for m in measures:
        positive = positive | (F.col(m) > 0)
    return out.filter(positive)


def group_concentration(df: DataFrame, modes: dict[str, Column], top: int = 5) -> DataFrame:
    """Per grouping mode: groups, largest, its share, singletons, mean size and the dominant groups as text."""
    pairs = F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(F.nullif(text(c), F.lit("")), F.lit("unknown")).alias("value"))
                      for m, c in modes.items()])
    counts = df.select(F.inline(pairs)).groupBy("mode", "value").agg(F.count(F.lit(1)).alias("n"))
    best = top_rows(counts, ["mode"], [F.col("n").desc(), F.col("value")], top, rank="r").groupBy("mode").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "value", "n"))),
                                 lambda s: F.concat(s["value"], F.lit("="), s["n"].cast("string"))), "; ").alias("dominant"))
    stats = counts.groupBy("mode").agg(
        F.count(F.lit(1)).alias("group_count"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"),
        F.round(F.avg("n"), 4).alias("mean_size"), F.round(F.max("n") / F.sum("n"), 4).alias("largest_fraction"))
    return stats.join(best, "mode")


def outcome_mismatches(outcomes: DataFrame, expected: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Derived flags compared with expected flags: the names that differ and how many were compared."""
    want = expected.select(key, *[F.col(f).alias(f"_want_{f}") for f in fields])
    joined = outcomes.join(want, key)
    differ = F.array_compact(F.array(*[
        F.when(F.col(f"_want_{f}").isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_want_{f}")), f) for f in fields]))
    compared = sum([F.col(f"_want_{f}").isNotNull().cast("int") for f in fields], F.lit(0))
    return joined.select(key, F.array_join(differ, ",").alias("mismatches"), compared.alias("compared"))


def split_winners(metrics: DataFrame, left: str, right: str) -> DataFrame:
    """Winner per split by the smaller error; ties and missing sides named."""
    a, b = F.col(left), F.col(right)
    return metrics.withColumn(
        "winner", F.when(a.isNull() & b.isNull(), "no_comparison").when(a.isNull(), right).when(b.isNull(), left)
        .when(b < a, right).when(a < b, left).otherwise("tie"))


def run_ranking(runs: DataFrame, higher_is_better: str, value: str, run_id: str) -> DataFrame:
    """Runs ordered by metric in its own direction (a run list is small)."""
    key = F.when(F.col(higher_is_better), -F.col(value)).otherwise(F.col(value))
    return runs.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(key.asc_nulls_last(), run_id)))


def pathway_risk(pairs: DataFrame, pathways: DataFrame, targets: Sequence[str], support: float = 0.0) -> DataFrame:
    """Binding strength, pathway Jaccard, conflict share and weighted risk over pairs hitting ``targets``.

    ``pairs``: receptor (array), log_value, conflict; ``pathways``: protein, pathway.
    """
    wanted = F.array(*[F.lit(t) for t in targets])
    hit = pairs.filter(F.arrays_overlap("receptor", wanted))
    asked = pathways.filter(F.col("protein").isin(list(targets))).select("pathway", F.lit(True).alias("asked"))
    found = hit.select(F.explode("receptor").alias("protein")).distinct().join(pathways, "protein").select(
        "pathway", F.lit(False).alias("asked"))
    sides = asked.unionByName(found).distinct().groupBy("pathway").agg(
        F.bool_or("asked").alias("a"), F.bool_or(~F.col("asked")).alias("b"))
    overlap = sides.agg(F.count_if(F.col("a") & F.col("b")).alias("overlap_count"), F.count(F.lit(1)).alias("union_count"))
    stats = hit.agg(F.count(F.lit(1)).alias("pair_count"), F.count_if("conflict").alias("conflict_count"),
                    F.avg("log_value").alias("_mean"))
    one = F.lit(1).alias("_one")
    row = stats.select("*", one).join(overlap.select("*", one), "_one")
    strength = F.when(F.col("pair_count") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.coalesce("_mean", F.lit(0.0)) / 6.0))
                      ).otherwise(0.0)
    similar = F.coalesce(F.try_divide("overlap_count", "union_count"), F.lit(0.0))
    conflict = F.coalesce(F.try_divide("conflict_count", "pair_count"), F.lit(0.0))
    risk = F.greatest(F.lit(0.0), 0.45 * strength + 0.35 * similar + 0.20 * F.lit(support) - 0.25 * conflict)
    return row.select(
        "pair_count", "conflict_count", "overlap_count", "union_count", F.round(strength, 4).alias("binding_strength"),
        F.round(similar, 4).alias("pathway_similarity"), F.round(risk, 4).alias("risk_score"),
        F.when(risk >= 0.7, "high").when(risk >= 0.35, "medium").otherwise("low").alias("severity"))
