"""Training examples and split items: chains of pre-reduced left joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.functions.keys import mutation_family, pair_family_key, parse_pair_key
from affinityloom.functions.text import text
from affinityloom.operators.ordering import first_rows


def primary_chain(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """First receptor chain that exists, else the entry's first chain by id, looked up in the chains of the entry.

    Of several rows of a chain the first counts. A list holds the chain rows of one entry.
    """
    listed = chains.groupBy("entry_id").agg(F.collect_list(F.struct("chain_id", "ord", "accession", "organism")).alias("_chains"))
    first = lambda r: F.array_min(F.filter("_chains", lambda c: c["chain_id"] == r))
    hits = F.filter(F.transform("receptor", first), lambda c: c.isNotNull())
    chosen = F.coalesce(F.try_element_at(hits, F.lit(1)), F.array_min("_chains"))
    return pairs.join(listed, "entry_id", "left").withColumn("_chain", chosen).select(
        *pairs.columns, *[F.col(f"_chain.{c}").alias(c) for c in ("chain_id", "accession", "organism")])


def assemble_examples(assays: DataFrame, entries: DataFrame, chains: DataFrame) -> DataFrame:
    """One example per (pair, type): the first assay row, its entry and primary chain, and a label
    that falls back to the group mean.

    First row and mean come from one aggregate, so assays are moved once and examples once, by entry.
    """
    key = ["pair_key", "kind"]
    facts = ["receptor", "ligand_key", "source", "log_value"]
    grouped = assays.groupBy(*key).agg(F.min(F.struct("entry_id", "ord", *facts)).alias("_first"), F.round(F.avg("log_value"), 6).alias("_mean"))
    first = grouped.select(*key, "_mean", *[F.col(f"_first.{c}").alias(c) for c in ("entry_id", *facts)])
    return primary_chain(first, chains).join(entries, "entry_id", "left").select(
        *key, "entry_id", "chain_id", "accession", "organism", "ligand_key", "source", "method", "resolution",
        F.coalesce(F.round("log_value", 6), "_mean").alias("label"),
        F.when(F.col("log_value").isNotNull(), "assay").when(F.col("_mean").isNotNull(), "group_mean").otherwise("none")
        .alias("label_source"))


def split_items(assays: DataFrame, chains: DataFrame) -> DataFrame:
    """Split items: receptor identity (accessions, else entry and chains), group, scaffold and mutation keys."""
    key = ["pair_key", "kind"]
    items = assays.select(*key, "entry_id", "receptor", "ligand_key").distinct()
    named = first_rows(chains, ["entry_id", "chain_id"], ["ord"]).select("entry_id", "chain_id", "accession")
    linked = items.select(*key, "entry_id", F.explode("receptor").alias("chain_id")).join(named, ["entry_id", "chain_id"], "left")
    ids = linked.groupBy(*key).agg(
        F.array_join(F.sort_array(F.collect_set(F.nullif("accession", F.lit("")))), "|").alias("_acc"))
    own = F.concat(F.col("entry_id"), F.lit(":"), F.when(F.size("receptor") == 0, "-").otherwise(F.array_join("receptor", ",")))
    identity = F.when(text("_acc") != "", F.col("_acc")).otherwise(own)
    parsed = parse_pair_key("pair_key")
    return items.join(ids, key, "left").withColumn("receptor_identity", identity).select(
        F.concat_ws("|", *key).alias("item_id"), *key, "receptor_identity",
        pair_family_key(parsed["task"], F.col("receptor_identity"), F.coalesce(parsed["ligand"], F.lit("")),
                        F.array_join(parsed["partner"], ",")).alias("hard_group_key"),
        F.col("ligand_key").alias("scaffold_key"), mutation_family(parsed["mutation"]).alias("mutation_family"))
