"""Release gates: constraint checks, issues, exclusions, canonical projections, readiness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinityloom.functions.quality import named
from affinityloom.functions.text import text, trimmed_parts

# Issue kinds that keep a pair out of the model-ready set.
BLOCKERS = [
    "ambiguous_mutation_context", "missing_structure_file", "no_matched_interface",
    "non_high_confidence_assay_fields", "source_value_conflict",
]
# Confidence fields that are critical for release.
CRITICAL_FIELDS = ["binding_affinity_log10_standardized", "binding_affinity_type"]


@dataclass
class SearchCriteria:
    """Conjunctive entry search; unset fields add no condition."""

    ids: Sequence[str] = ()
    keyword: str | None = None
    organism: str | None = None
    taxonomy: int | None = None
    methods: Sequence[str] = ()
    membrane_only: bool = False
    max_resolution: float | None = None
    require_protein: bool = False
    min_protein_entities: int | None = None
    require_multimer: bool = False
    require_ligand: bool = False
    require_branched: bool = False
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    task_types: Sequence[str] = ()
    release_years: tuple[int | None, int | None] = (None, None)


def search_predicate(c: SearchCriteria, cols: dict[str, str]) -> Column:
    """One boolean expression over the named columns, so simple comparisons push down to the scan."""
    for name, (low, high) in c.ranges.items():
        if low is not None and high is not None and low > high:
            raise ValueError(f"{name}: lower bound above upper bound")
    col = lambda n: F.col(cols[n])
    tests: list[Column] = []
    if c.ids:
        tests.append(col("id").isin(list(dict.fromkeys(c.ids))))
    if c.keyword:
        tests.append(F.lower(col("text")).contains(c.keyword.lower()))
    if c.organism:
        tests.append(F.lower(col("organism")).contains(c.organism.lower()))
    if c.taxonomy is not None:
        tests.append(col("taxonomy") == c.taxonomy)
    if c.methods:
        tests.append(col("method").isin(list(c.methods)))
    if c.membrane_only:
        tests.append(F.lower(col("keywords")).contains("membrane") | F.lower(col("text")).contains("membrane"))
    if c.max_resolution is not None:
        tests.append(col("resolution") <= c.max_resolution)
    if c.min_protein_entities is not None:
        tests.append(col("proteins") >= c.min_protein_entities)
    else:
        if c.require_protein:
            tests.append(col("proteins") > 0)
        if c.require_multimer:
            tests.append(col("proteins") >= 2)
    if c.require_ligand:
        tests.append(col("nonpolymers") > 0)
    if c.require_branched:
        tests.append(col("branched") > 0)
    for name, (low, high) in c.ranges.items():
        if low is not None:
            tests.append(col(name) >= low)
        if high is not None:
            tests.append(col(name) <= high)
    if c.task_types and not set(c.task_types) >= {"protein_ligand", "protein_protein", "mutation_ddg"}:
        kinds = []
        if "protein_ligand" in c.task_types:
            kinds.append((col("proteins") >= 1) & (col("nonpolymers") > 0))
        if "protein_protein" in c.task_types:
            kinds.append(col("proteins") >= 2)
        if kinds:
            tests.append(reduce(or_, kinds))
    low, high = c.release_years
    if low is not None:
        tests.append(col("released") >= F.lit(f"{low:04d}-01-01").cast("timestamp_ntz"))
    if high is not None:
        tests.append(col("released") < F.lit(f"{high + 1:04d}-01-01").cast("timestamp_ntz"))
    return reduce(and_, tests, F.lit(True)) if tests else F.lit(True)


def constraint_violations(cols: dict[str, Column], tasks: Sequence[str]) -> Column:
    """Ordered names of violated record constraints."""
    bad = [
        (~cols["score"].between(0.0, 1.0), "quality_score_range"),
        (~cols["ph"].between(0.0, 14.0), "ph_range"),
        (cols["resolution"] <= 0, "resolution_positive"),
        (cols["temperature"] <= -273.15, "temperature_above_absolute_zero"),
        (cols["ionic"] < 0, "ionic_strength_non_negative"),
        (text(cols["ingested_at"]) == "", "provenance_has_ingested_at"),
        (~cols["task"].isin(list(tasks)), "task_type"),
    ]
    return named(bad)


def unknown_keys(values: Column | str, known: Sequence[str]) -> Column:
    return F.sort_array(F.array_except(F.map_keys(values), F.array(*[F.lit(k) for k in known])))


def mode_keeps(mode: str, task: Column, family: Column, penalty: Column) -> Column:
    if mode in ("protein_ligand", "protein_protein"):
        return task == mode
    if mode == "mutation_effect":
        return family != "wildtype_family"
    if mode == "high_trust":
        return penalty <= 0.0
    return F.lit(True)


def non_high_fields(confidence: Column | str) -> Column:
    """Sorted names of a confidence map whose level is neither blank nor high."""
    return F.sort_array(F.map_keys(F.map_filter(
        confidence, lambda k, v: ~F.lower(F.coalesce(v, F.lit(""))).isin("", "high"))))


def _issues(scope: str, entry: str, pair: Column, found: list[tuple[Column, str, Column]]) -> Column:
    return F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(scope).alias("scope"), F.col(entry).alias("entry_id"), pair.alias("pair_key"),
                              F.lit(kind).alias("issue_type"), details.alias("details")))
        for test, kind, details in found
    ]))


def entry_issues(entries: DataFrame, assay_counts: DataFrame, missing_descriptors: DataFrame) -> DataFrame:
    """Entry-scope issues in one pass. ``entries`` needs structure_path and a confidence map."""
    low = F.array_join(non_high_fields("confidence"), "; ")
    rows = entries.join(assay_counts, "entry_id", "left").join(missing_descriptors, "entry_id", "left")
    return rows.select(F.inline(_issues("entry", "entry_id", F.lit(""), [
        (text("structure_path") == "", "missing_structure_file", F.lit("no structure path")),
        (F.coalesce("assay_count", F.lit(0)) == 0, "no_assay_data", F.lit("no assay rows")),
        (low != "", "non_high_confidence_fields", low),
        (text("missing_components") != "", "missing_ligand_descriptors", F.col("missing_components")),
    ])))


def pair_issues(pairs: DataFrame) -> DataFrame:
    """Pair-scope issues. Needs matching_interface_count, confidence map, override_used, is_mutant,
    conflict_flag and conflict_summary."""
    return pairs.select(F.inline(_pair_issue_list()))


def _pair_issue_list() -> Column:
    low = non_high_fields("confidence")
    critical = F.filter(low, lambda f: f.isin(CRITICAL_FIELDS))
    advisory = F.filter(low, lambda f: ~f.isin(CRITICAL_FIELDS))
    excused = F.coalesce("override_used", F.lit(False)) & (F.col("is_mutant") == F.lit(False))
    return _issues("pair", "entry_id", F.col("pair_key"), [
        (F.coalesce("matching_interface_count", F.lit(0)) == 0, "no_matched_interface", F.lit("no interface matched")),
        (F.col("pair_key").contains("mutation_unknown") & ~F.coalesce(excused, F.lit(False)),
         "ambiguous_mutation_context", F.lit("mutation unknown")),
        (F.coalesce("conflict_flag", F.lit(False)), "source_value_conflict",
         F.coalesce("conflict_summary", F.lit("conflicting source values"))),
        (F.size(critical) > 0, "non_high_confidence_assay_fields", F.array_join(critical, "; ")),
        (F.size(advisory) > 0, "advisory_non_high_confidence_assay_fields", F.array_join(advisory, "; ")),
    ])


def gate_pairs(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """Pairs with their issue types and exclusion reasons (empty = model-ready).

    Issue types are a fixed vocabulary, so the collected sets are small.
    """
    by_pair = issues.filter("scope = 'pair'").groupBy("entry_id", "pair_key").agg(
        F.collect_set("issue_type").alias("_pair"))
    return _gated(pairs.join(by_pair, ["entry_id", "pair_key"], "left"), issues.filter("scope = 'entry'"))


def gate_own_pairs(pairs: DataFrame, entry_issues: DataFrame) -> DataFrame:
    """``gate_pairs`` of the pairs' own ``pair_issues`` and issues of scope entry.

    Pairs are neither made twice nor moved to meet their issues: rows that are dealt by entry stay where they are, and the
    issues of an (entry, pair) are gathered over its rows, which are sorted in their task.
    """
    own = F.transform(_pair_issue_list(), lambda i: i["issue_type"])
    known = F.col("entry_id").isNotNull() & F.col("pair_key").isNotNull()
    rows = pairs.withColumn("_own", F.when(known, own)).withColumn(
        "_pair", F.flatten(F.collect_set("_own").over(Window.partitionBy("entry_id", "pair_key"))))
    return _gated(rows.drop("_own"), entry_issues.filter("scope = 'entry'"))


def _gated(rows: DataFrame, entry_issues: DataFrame) -> DataFrame:
    """``rows`` with the pair's issue types in ``_pair``."""
    by_entry = entry_issues.groupBy("entry_id").agg(F.collect_set("issue_type").alias("_entry"))
    none = F.array().cast("array<string>")
    joined = rows.join(by_entry, "entry_id", "left")
    kinds = F.sort_array(F.array_union(F.coalesce("_pair", none), F.coalesce("_entry", none)))
    extra = named([(text("preferred_source") == "", "missing_preferred_source"),
                   (F.col("log_value").isNull(), "missing_standardized_affinity")])
    blockers = F.array_intersect(kinds, F.array(*[F.lit(b) for b in BLOCKERS]))
    return joined.withColumn("issue_types", F.array_join(kinds, "; ")).withColumn(
        "exclusion_reasons", F.array_join(F.sort_array(F.array_union(blockers, extra)), "; ")).drop("_pair", "_entry")


def conflict_defaults(summary: Column, band: Column, count: Column, flag: Column, value: Column,
                      mean: Column) -> Column:
    """Conflict summary and band with defaults for rows that carry neither."""
    s, b = text(summary), F.lower(text(band))
    have = (s != "") & (b != "")

    def pick(text_default: str, band_default: str) -> Column:
        return F.struct(F.coalesce(F.nullif(s, F.lit("")), F.lit(text_default)).alias("summary"),
                        F.coalesce(F.nullif(b, F.lit("")), F.lit(band_default)).alias("band"))

    return (
        F.when(have, F.struct(s.alias("summary"), b.alias("band")))
        .when(F.coalesce(flag, F.lit(False)), pick("conflict_flagged_without_spread_summary", "low"))
        .when(F.coalesce(count, F.lit(0)) <= 1,
              pick("single_measurement_no_cross_source_conflict_assessment", "not_assessed_single_source"))
        .when(value.isNull() & mean.isNull(),
              pick("multiple_measurements_without_standardized_affinity_conflict_assessment",
                   "not_assessed_missing_standardized_values"))
        .otherwise(pick("multiple_measurements_without_explicit_conflict_summary", "not_assessed_multi_measurement"))
    )


def mutation_strings(listed: Column, mutation_key: Column) -> Column:
    """Listed mutations, else the key's own token, else ``wt``; empty when the key has none."""
    values = trimmed_parts(listed, ";")
    key = text(mutation_key)
    return F.when(F.size(values) > 0, F.array_join(values, "; ")).when(key == "", "").when(
        F.lower(key).isin("wt", "wildtype", "wt_or_unspecified"), "wt").otherwise(key)


def input_resolution(entries: DataFrame, listing: DataFrame, path: str) -> DataFrame:
    """Entries with a resolution status: resolved, or the reason they are rejected."""
    files = listing.select(F.col("file_path").alias("_file")).distinct()
    return entries.join(files, F.col(path) == F.col("_file"), "left").withColumn(
        "resolution_status",
        F.when(text(path) == "", "missing_structure_reference").when(F.col("_file").isNull(), "structure_file_missing_on_disk")
        .otherwise("resolved")).drop("_file")


def split_readiness(strategy: str, pairs: DataFrame, split: str, status: str) -> DataFrame:
    """One row: held-out counts, assignment coverage and strategy family."""
    grade = {"pair_aware_grouped": "release_grade", "pair_aware": "release_grade", "time_ordered": "release_grade",
             "hash": "exploratory", "cluster_aware": "exploratory"}.get(strategy, "unknown")
    assigned = F.count_if(F.col(split).isin("train", "val", "test"))
    return pairs.agg(
        F.count(F.lit(1)).alias("pair_count"), assigned.alias("assigned_count"),
        F.count_if(F.col(split).isin("val", "test")).alias("held_out_count"),
    ).select(
        F.lit(strategy).alias("strategy"), F.lit(grade).alias("strategy_family"), "pair_count", "assigned_count",
        "held_out_count", F.round(F.coalesce(F.try_divide("assigned_count", "pair_count"), F.lit(0.0)), 6).alias("coverage"),
        F.lit(status).alias("diagnostic_status"))


def release_readiness(counts: DataFrame, blockers: dict[str, Column], warnings: dict[str, Column]) -> DataFrame:
    """Blockers and warnings of a one-row count frame; blocked when any blocker holds."""
    bad, soft = named([(t, n) for n, t in blockers.items()]), named([(t, n) for n, t in warnings.items()])
    return counts.select(
        F.when(F.size(bad) > 0, "blocked").otherwise("ready").alias("release_status"),
        F.array_join(bad, ",").alias("blockers"), F.array_join(soft, ",").alias("warnings"))
