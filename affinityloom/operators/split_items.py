"""Split items of pairs: identity, representation and every grouping key that a split may keep together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinityloom.functions.keys import parse_pair_key
from affinityloom.functions.text import blank_to_null, distinct_parts, first_text, text
from affinityloom.operators.ordering import first_rows

KEYS = ["receptor_identity", "representation_key", "hard_group_key", "scaffold_key", "family_key", "domain_group_key", "pathway_group_key",
        "fold_group_key", "mutation_group_key", "source_group_key", "release_date"]


def _lasting(value: Column, *order: Column | str) -> Column:
    """``value`` of the last row in ``order``: an aggregate."""
    return F.max(F.struct(*order, value.alias("v")))["v"]


def _chain_facts(chains: DataFrame) -> DataFrame:
    """Per upper-case entry: the last non-blank sequence and accession of each (entry, chain), as a map."""
    known = chains.select("entry_id", "chain_id", "ord", *[F.when(text(c) != "", F.col(c)).alias(c) for c in ("sequence", "accession")])
    known = known.where("entry_id IS NOT NULL AND chain_id IS NOT NULL AND (sequence IS NOT NULL OR accession IS NOT NULL)")
    last = known.groupBy("entry_id", "chain_id").agg(*[
        _lasting(F.col(c), F.col(c).isNotNull().alias("known"), "ord").alias(c) for c in ("sequence", "accession")])
    named = F.struct(F.struct("entry_id", "chain_id").alias("k"), F.struct("sequence", "accession").alias("v"))
    return last.groupBy(F.upper("entry_id").alias("_upper")).agg(F.map_from_entries(F.collect_list(named)).alias("_chains"))


def _dates(entries: DataFrame) -> DataFrame:
    """Per upper-case entry: the last non-blank release day of each entry, as a map."""
    last = entries.where((text("release_date") != "") & F.col("entry_id").isNotNull()).groupBy("entry_id").agg(
        _lasting(F.left("release_date", F.lit(10)), "ord").alias("day"))
    return last.groupBy(F.upper("entry_id").alias("_upper")).agg(
        F.map_from_entries(F.collect_list(F.struct("entry_id", "day"))).alias("_days"))


def _metadata_facts(metadata: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Families, pathway and fold of the first metadata row per pair (``_own``) and per upper-case entry (``_shared``)."""
    facts = F.struct(
        F.array_join(F.when(F.size(distinct_parts("interpro_ids")) > 0, distinct_parts("interpro_ids")).otherwise(distinct_parts("pfam_ids")), ",").alias("family"),
        F.try_element_at(distinct_parts("pathway_ids"), F.lit(1)).alias("pathway"),
        F.trim(F.coalesce(F.nullif("structural_fold", F.lit("")), F.col("oligomeric_state"), F.lit(""))).alias("fold"))
    rows = metadata.select(F.trim("pair_key").alias("pair_key"), F.upper(F.trim("entry_id")).alias("_upper"), "ord", facts.alias("facts"))
    by_pair = first_rows(rows.filter(text("pair_key") != ""), ["pair_key"], ["ord"]).select("pair_key", F.col("facts").alias("_own"))
    by_entry = first_rows(rows.filter(text("_upper") != ""), ["_upper"], ["ord"]).select("_upper", F.col("facts").alias("_shared"))
    return by_pair, by_entry


def _examples(examples: DataFrame) -> DataFrame:
    """Per pair: its examples with kind, and the ligand and label source that the last row of each example id names.

    An item without an example is named ``pair|kind``; an example of that very id lends it its facts. Such ids are listed
    under the pairs they can name (``lends``), as a known key has four or five parts. A list holds one pair's examples.
    """
    known = examples.filter((text("pair_key") != "") & (text("example_id") != ""))
    facts = F.struct(F.col("ord"), first_text("inchikey", "smiles", "ligand_id").alias("ligand"), first_text("label_source", "experiment_source").alias("label"))
    rows = known.select("pair_key", F.coalesce("kind", F.lit("")).alias("kind"), "example_id", F.max(facts).over(Window.partitionBy("example_id")).alias("f"))
    listed = rows.select("pair_key", F.struct(F.lit(False).alias("lends"), "kind", "example_id", "f.ligand", "f.label").alias("e"))
    lent = rows.where(F.col("example_id").contains("|")).select("example_id", "f").distinct().select(
        F.explode(F.array(*[F.substring_index("example_id", "|", n) for n in (4, 5)])).alias("pair_key"), "example_id", "f")
    lent = lent.where(F.length("example_id") > F.length("pair_key")).select("pair_key", F.struct(
        F.lit(True).alias("lends"), F.expr("substring(example_id, length(pair_key) + 2)").alias("kind"), "example_id", "f.ligand", "f.label").alias("e"))
    return listed.unionByName(lent).groupBy("pair_key").agg(F.collect_list("e").alias("_examples"))


def joined_key(task: Column, *parts: Column) -> Column:
    """Parts under their task; blank where the first part is blank."""
    return F.when(text(parts[0]) != "", F.concat_ws("|", task, *parts)).otherwise("")


def pair_split_items(assays: DataFrame, chains: DataFrame, entries: DataFrame, examples: DataFrame, metadata: DataFrame) -> DataFrame:
    """One item per assay row and training example of its (pair, type); without an example the pair and type name it.

    Columns read: ``assays`` pair_key, kind, entry_id, source, selected_source; ``chains`` entry_id, chain_id, ord,
    sequence, accession; ``entries`` entry_id, ord, release_date; ``examples`` example_id, pair_key, kind, ord, inchikey,
    smiles, ligand_id, label_source, experiment_source; ``metadata`` pair_key, entry_id, ord, interpro_ids, pfam_ids,
    pathway_ids, structural_fold, oligomeric_state. Others are ignored. Assays whose key is blank or of no known shape
    give no item. The rows are moved twice, while narrow: by pair key to the facts of the pair, then by entry to those of
    the entry; the receptor's chains are looked up in the entry's own map, and the long keys are built after the last join.
    """
    by_pair, by_entry = _metadata_facts(metadata)
    parsed = parse_pair_key("pair_key")
    rows = assays.where((text("pair_key") != "") & parsed.isNotNull()).select(
        "pair_key", F.coalesce("kind", F.lit("")).alias("_kind"), F.coalesce(parsed["entry"], "entry_id", F.lit("")).alias("_entry"),
        first_text("selected_source", "source").alias("_source"))
    assay_kind = F.coalesce(F.nullif("_kind", F.lit("")), F.lit("assay_unknown"))
    of_kind = F.filter("_examples", lambda e: ~e["lends"] & (e["kind"] == F.col("_kind")))
    lent = F.try_element_at(F.filter("_examples", lambda e: e["lends"] & (e["kind"] == assay_kind)), F.lit(1))
    bare = F.array(F.struct(F.concat_ws("|", "pair_key", assay_kind).alias("item_id"), lent["ligand"].alias("ligand"), lent["label"].alias("label")))
    mine = F.when(F.size(of_kind) > 0, F.transform(of_kind, lambda e: F.struct(
        e["example_id"].alias("item_id"), e["ligand"].alias("ligand"), e["label"].alias("label")))).otherwise(bare)
    named = rows.join(by_pair, "pair_key", "left").join(_examples(examples), "pair_key", "left").select(
        "pair_key", "_kind", "_entry", "_own", "_source", F.inline(mine)).select(
        "pair_key", "_kind", "_entry", "_own", "item_id", "ligand", F.coalesce("label", "_source").alias("_source"))
    wide = named.withColumn("_upper", F.upper("_entry"))
    for facts in (_chain_facts(chains), _dates(entries), by_entry):
        wide = wide.join(facts, "_upper", "left")
    found = F.transform(F.col("_p.receptor"), lambda c: F.try_element_at("_chains", F.struct(F.col("_entry").alias("entry_id"), c.alias("chain_id"))))
    listed = lambda name: F.array_compact(F.transform("_found", lambda x: x[name]))
    own = F.concat("_entry", F.lit(":"), F.coalesce(blank_to_null(F.array_join("_p.receptor", ",")), F.lit("-")))
    wide = wide.withColumn("_p", parsed).withColumn("_found", found).withColumn(
        "receptor_sequence", blank_to_null(F.array_join(F.sort_array(listed("sequence")), "|"))).withColumn(
        "receptor_identity", F.coalesce(blank_to_null(F.array_join(F.sort_array(F.array_distinct(listed("accession"))), ",")), F.col("receptor_sequence"), own)).withColumn(
        "_m", F.coalesce("_own", "_shared")).withColumn("release_date", F.try_element_at("_days", F.col("_entry")))
    task, partner = F.col("_p.task"), F.array_join("_p.partner", ",")
    mutation = F.lower(F.coalesce(F.col("_p.mutation"), F.lit("wt_or_unspecified")))
    state = F.when(mutation.isin("wt", "wildtype", "wt_or_unspecified"), "wildtype").when(mutation.startswith("mutation_unknown"), "unknown").otherwise("mutant")
    ligand = F.coalesce(first_text("ligand", "_p.ligand", partner), F.lit("-"))
    source = F.coalesce("_source", F.lit("source_unknown"))
    family, identity = F.coalesce(F.col("_m.family"), F.lit("")), F.col("receptor_identity")
    family_or_receptor = F.when(family != "", family).otherwise(identity)
    return wide.select(
        "item_id", "pair_key", F.nullif("_kind", F.lit("")).alias("kind"), "receptor_sequence", identity,
        F.concat_ws("|", task, assay_kind, state, F.when(F.col("receptor_sequence").isNull(), "sequence_unknown").otherwise("has_sequence")).alias("representation_key"),
        F.concat_ws("|", task, identity, F.coalesce(F.col("_p.ligand"), F.nullif(partner, F.lit("")), F.lit("-"))).alias("hard_group_key"),
        F.concat_ws("|", task, ligand).alias("scaffold_key"), F.concat_ws("|", task, family_or_receptor).alias("family_key"),
        joined_key(task, family).alias("domain_group_key"), joined_key(task, F.col("_m.pathway")).alias("pathway_group_key"),
        joined_key(task, F.col("_m.fold")).alias("fold_group_key"),
        F.concat_ws("|", task, family_or_receptor, ligand, F.coalesce(blank_to_null(F.trim(mutation)), F.lit("wt_or_unspecified"))).alias("mutation_group_key"),
        F.concat_ws("|", task, source).alias("source_group_key"), "release_date")
