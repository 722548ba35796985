"""Feature rows: hashed text, sequence embeddings, numeric flattening, conformation states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinityloom.functions.hashing import char_ngrams, first_byte_bin, hashed_tokens, residue_fractions
from affinityloom.functions.text import text
from affinityloom.operators.ordering import top_rows


def hashed_feature_rows(df: DataFrame, key: str, column: str, prefix: str, bins: int,
                        ngrams: tuple[int, ...] = (1,)) -> DataFrame:
    """Long form (key, bucket, share): bucket counts over the row's tokens, divided by their number."""
    tokens = df.select(key, hashed_tokens(prefix, column, bins, ngrams).alias("_t"))
    exploded = tokens.select(key, F.size("_t").alias("_n"), F.explode("_t").alias("bucket"))
    return exploded.groupBy(key, "bucket").agg(
        F.round(F.count(F.lit(1)) / F.first("_n"), 6).alias("share")
    )


def sequence_embedding(df: DataFrame, key: str, sequence: str, dims: int = 32) -> DataFrame:
    """20 residue fractions plus md5-binned 3-mer shares, one row per key.

    The 3-mers are counted as rows, not inside one array, so a long sequence is spread by the
    partial aggregate; only distinct (key, 3-mer) pairs reach the hash.
    """
    bins = dims - 20
    seq = df.select(key, F.upper(F.coalesce(F.col(sequence), F.lit(""))).alias("_s"))
    grams = seq.select(key, F.explode(char_ngrams(F.col("_s"), 3)).alias("_g"))
    counted = grams.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_c")).withColumn(
        "_b", first_byte_bin(F.col("_g"), bins)
    )
    binned = counted.groupBy(key).agg(
        F.sum("_c").alias("_total"),
        *[F.sum(F.when(F.col("_b") == b, F.col("_c")).otherwise(0)).alias(f"_bin{b}") for b in range(bins)],
    )
    share = [F.coalesce(F.col(f"_bin{b}") / F.col("_total"), F.lit(0.0)) for b in range(bins)]
    return seq.join(binned, key, "left").select(
        key, F.concat(residue_fractions("_s"), F.array(*share)).alias("embedding")
    )


def numeric_paths(schema: T.StructType, prefix: str) -> list[tuple[str, str]]:
    """(dotted name, column path) of every numeric or boolean leaf below a struct."""
    out: list[tuple[str, str]] = []
    for field in schema.fields:
        path = f"{prefix}.{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += numeric_paths(field.dataType, path)
        elif isinstance(field.dataType, (T.NumericType, T.BooleanType)):
            out.append((path, path))
    return out


def numeric_feature_rows(df: DataFrame, key: str, sections: Sequence[str]) -> DataFrame:
    """Nested numeric sections as long (key, feature, value); booleans become 0/1."""
    leaves: list[tuple[str, str]] = []
    for section in sections:
        leaves += numeric_paths(df.schema[section].dataType, section)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(p).cast("double").alias("value")) for n, p in leaves])
    return df.select(key, F.inline(F.filter(pairs, lambda s: s["value"].isNotNull())))


def conformation_rows(entries: DataFrame) -> DataFrame:
    """One experimental state per entry, one planned predicted state where an accession is known."""
    known = text("accession") != ""
    observed = F.struct(
        F.concat(F.col("entry_id"), F.lit(":experimental")).alias("state_id"),
        F.when(known, F.col("accession")).otherwise(F.col("entry_id")).alias("target_id"),
        F.col("entry_id").alias("entry"),
        F.when(F.col("task_hint").isin("protein_ligand", "protein_protein"), "holo").alias("apo_or_holo"),
        F.nullif(F.col("task_hint"), F.lit("")).alias("ligand_class"),
        F.lit("experimental_observed").alias("conformation"), F.lit("high").alias("confidence"),
    )
    planned = F.struct(
        F.concat(F.col("accession"), F.lit(":alphafold_planned")).alias("state_id"),
        F.col("accession").alias("target_id"), F.lit(None).cast("string").alias("entry"),
        F.lit("apo_like").alias("apo_or_holo"), F.lit(None).cast("string").alias("ligand_class"),
        F.lit("predicted_pending").alias("conformation"), F.lit("planned").alias("confidence"),
    )
    return entries.select(F.inline(F.array_compact(F.array(observed, F.when(known, planned)))))


def interface_residue_summary(residues: DataFrame, structure: str, residue: str, ordinal: str, k: int = 50) -> DataFrame:
    """Distinct interface residues per structure: how many, and the first ``k`` in order as text."""
    distinct = residues.groupBy(structure, residue).agg(F.min(ordinal).alias("_o"))
    head = top_rows(distinct, [structure], ["_o"], k, rank="_n").groupBy(structure).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", residue))), lambda s: s[residue]), ",").alias("residues"))
    return distinct.groupBy(structure).agg(F.count(F.lit(1)).alias("residue_count")).join(head, structure)


def query_context_features(structure: str, sections: dict[str, DataFrame]) -> DataFrame:
    """Per-structure summaries merged to dotted numeric features in long form."""
    out = None
    for name, df in sections.items():
        numeric = [f.name for f in df.schema.fields if f.name != structure and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
        pairs = F.array(*[F.struct(F.lit(f"{name}.{c}").alias("feature"), F.col(c).cast("double").alias("value")) for c in numeric])
        part = df.select(structure, F.inline(F.filter(pairs, lambda s: s["value"].isNotNull())))
        out = part if out is None else out.unionByName(part)
    return out


def site_example_rows(records: DataFrame, pairs: DataFrame, record: str) -> DataFrame:
    """Example, label and meta fields per (record, pair): Kd values go to ``kd``; a record without pairs
    becomes one inference-only row. ``pairs``: record, position, pair_key, kind, value, mean."""
    joined = records.join(pairs, record, "left")
    have = F.col("pair_key").isNotNull()
    label = F.coalesce(F.nullif("value", F.lit(0.0)), "mean")
    return joined.select(
        record, F.when(have, F.concat_ws(":", F.col(record).cast("string"), F.col("position").cast("string"))).alias("example_id"),
        "pair_key", F.when(F.col("kind") == "Kd", label).alias("kd"), F.nullif("kind", F.lit("")).alias("class_label"),
        F.when(have, F.coalesce(F.nullif(F.split("pair_key", r"\|")[0], F.lit("")), F.lit("unknown"))).otherwise("inference_ready_only").alias("task"),
        (have & label.isNotNull()).alias("supervised"))
