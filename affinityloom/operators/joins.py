"""Entry, pair and identity joins.

Lookups by "any of several keys" become equi-joins on exploded keys, per-entry list matching becomes
a join of distinct signatures, and counts are aggregated before they are joined. No join here is a
nested loop, and no per-entry list is matched row against row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.functions.text import blank_to_null, text
from affinityloom.operators.ordering import first_rows, top_rows


def bulk_measurement_join(entry_map: DataFrame, measures: DataFrame, lookups: Sequence[tuple[DataFrame, str]],
                          on: str) -> DataFrame:
    """Entry map joined to measurements (inner), then left lookups in order."""
    out = entry_map.join(measures, on)
    for lookup, key in lookups:
        out = out.join(lookup, key, "left")
    return out


def match_any_key(pairs: DataFrame, objects: DataFrame, entry: str, wanted: str, keys: Sequence[str], ordinal: str,
                  payload: Sequence[str], pair_id: Sequence[str]) -> DataFrame:
    """First object of the same entry one of whose keys equals ``wanted``; else the entry's first object."""
    listed = F.array_distinct(F.array_compact(F.array(*[blank_to_null(k) for k in keys])))
    by_key = first_rows(
        objects.select(entry, ordinal, *payload, F.explode(listed).alias("_key")), [entry, "_key"], [ordinal])
    first = first_rows(objects.select(entry, ordinal, *payload), [entry], [ordinal])
    hit = by_key.select(entry, F.col("_key").alias(wanted), F.struct(*payload).alias("_hit"))
    spare = first.select(entry, F.struct(*payload).alias("_spare"))
    chosen = F.coalesce("_hit", "_spare")
    return pairs.join(hit, [entry, wanted], "left").join(spare, entry, "left").select(
        *pair_id, *[chosen[p].alias(p) for p in payload], F.col("_hit").isNotNull().alias("matched_by_key"))


def all_key_matches(pairs: DataFrame, objects: DataFrame, entry: str, wanted: str, keys: Sequence[str],
                    columns: Sequence[str]) -> DataFrame:
    """Sorted distinct values of every matching object per (entry, wanted): small vocabularies joined as text."""
    listed = F.array_distinct(F.array_compact(F.array(*[blank_to_null(k) for k in keys])))
    slim = objects.select(entry, *columns, F.explode(listed).alias(wanted)).distinct()
    asked = pairs.filter(text(wanted) != "").select(entry, wanted).distinct()
    return slim.join(asked, [entry, wanted], "left_semi").groupBy(entry, wanted).agg(
        *[F.array_join(F.sort_array(F.collect_set(blank_to_null(c))), "; ").alias(c) for c in columns])


def interface_matches(pairs: DataFrame, interfaces: DataFrame, entry: str, receptor: str, ligand: str, chains: str,
                      partner: str, kind: str, unlisted_matches: bool = True) -> DataFrame:
    """Matching interface count and types per distinct (entry, receptor chains, ligand).

    A face matches when chain lists overlap (skipped when the pair names none) and its partner name,
    if both sides have one, equals the ligand. ``unlisted_matches`` says whether a face without a
    chain list matches. Both sides are reduced to distinct signatures first.
    """
    asked = pairs.select(entry, receptor, ligand).distinct()
    faces = interfaces.select(entry, F.sort_array(chains).alias("_chains"), text(partner).alias("_partner"), kind
                              ).groupBy(entry, "_chains", "_partner", kind).agg(F.count(F.lit(1)).alias("_n"))
    none = F.size("_chains") == 0
    overlap = F.arrays_overlap(F.col(receptor), F.col("_chains"))
    chain_ok = (F.size(receptor) == 0) | overlap | (none if unlisted_matches else F.lit(False))
    name_ok = (text(ligand) == "") | (F.col("_partner") == "") | (F.col("_partner") == F.col(ligand))
    return asked.join(faces, entry).filter(chain_ok & name_ok).groupBy(entry, receptor, ligand).agg(
        F.sum("_n").alias("matching_interface_count"),
        F.array_join(F.sort_array(F.collect_set(kind)), "; ").alias("matching_interface_types"))


def chain_sets(pairs: DataFrame, chains: DataFrame, entry: str, receptor: str, chain: str,
               columns: Sequence[str]) -> DataFrame:
    """Sorted distinct chain attributes of the receptor chains, per distinct (entry, receptor)."""
    asked = pairs.select(entry, receptor).distinct().withColumn(chain, F.explode(receptor))
    named = chains.select(entry, chain, *columns).distinct()
    return asked.join(named, [entry, chain]).groupBy(entry, receptor).agg(
        *[F.array_join(F.sort_array(F.collect_set(blank_to_null(c))), "; ").alias(c) for c in columns])


def _entry_lists(chains: DataFrame, objects: DataFrame, interfaces: DataFrame) -> tuple[DataFrame, ...]:
    """Per entry: its distinct chains, objects and counted interface signatures, each as a list.

    Lists hold what differs within one entry; partial aggregates merge repeats before they move.
    """
    ids = F.array_distinct(F.array_compact(F.array(*[blank_to_null(k) for k in ("component_id", "component_name", "inchikey")])))
    owned = chains.groupBy("entry_id").agg(F.collect_set(F.struct("chain_id", "accession", "organism")).alias("_chains"))
    held = objects.groupBy("entry_id").agg(F.collect_set(F.struct(ids.alias("ids"), "component_type")).alias("_objects"))
    faces = interfaces.groupBy("entry_id", F.sort_array("chains").alias("chains"), text("partner").alias("partner"), "interface_type").agg(
        F.count(F.lit(1)).alias("n")).groupBy("entry_id").agg(F.collect_list(F.struct("chains", "partner", "interface_type", "n")).alias("_faces"))
    return owned, held, faces


def _names(listed: Column, name: str) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.transform(listed, lambda x: blank_to_null(x[name]))))), "; ")


def pair_master(assays: DataFrame, entries: DataFrame, chains: DataFrame, objects: DataFrame, interfaces: DataFrame,
                features: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per assay with entry fields, receptor sets, ligand and interface matches, split and counts.

    The rows are moved twice: by pair key to split and feature count, then by entry to the lists of their entry, in which
    each row looks up its receptor's chains, its ligand and its interfaces. A list of splits holds one pair's kinds.
    """
    assigned = [c for c in splits.columns if c not in ("pair_key", "kind")]
    counted = features.groupBy("pair_key").agg(F.count(F.lit(1)).alias("feature_count"))
    listed = splits.groupBy("pair_key").agg(F.collect_list(F.struct("kind", F.struct(*assigned).alias("s"))).alias("_splits"))
    mine = F.transform(F.filter("_splits", lambda x: x["kind"] == F.col("kind")), lambda x: x["s"])
    rows = assays.join(counted, "pair_key", "left").join(listed, "pair_key", "left")
    rows = rows.select(*[c for c in rows.columns if c != "_splits"], F.explode_outer(mine).alias("_s"))
    rows = rows.select(*[c for c in rows.columns if c != "_s"], "_s.*")
    wide = rows
    for facts in (*_entry_lists(chains, objects, interfaces), entries):
        wide = wide.join(facts, "entry_id", "left")
    parts = F.split("pair_key", r"\|")
    wide = wide.withColumn("receptor", F.filter(F.split(parts[2], ","), lambda x: ~x.isin("", "-"))).withColumn("ligand_key", parts[3])
    receptor, ligand = F.col("receptor"), F.col("ligand_key")
    own = F.filter("_chains", lambda c: F.array_contains(receptor, c["chain_id"]))
    named = F.when(text("ligand_key") != "", F.filter("_objects", lambda o: F.array_contains(o["ids"], ligand)))
    met = F.when(receptor.isNotNull() & ligand.isNotNull(), F.filter("_faces", lambda f: ((F.size(receptor) == 0) | F.arrays_overlap(receptor, f["chains"]) | (F.size(f["chains"]) == 0))
                   & ((text("ligand_key") == "") | (f["partner"] == "") | (f["partner"] == ligand))))
    return wide.withColumn("_met", met).withColumn("accession", _names(own, "accession")).withColumn("organism", _names(own, "organism")).withColumn(
        "component_type", _names(named, "component_type")).withColumn(
        "matching_interface_count", F.aggregate("_met", F.lit(0).cast("bigint"), lambda s, f: s + f["n"])).withColumn(
        "matching_interface_types", F.array_join(F.sort_array(F.array_distinct(F.array_compact(F.transform("_met", lambda f: f["interface_type"])))), "; ")).drop(
        "_chains", "_objects", "_faces", "_met").na.fill({
            "matching_interface_count": 0, "feature_count": 0, "matching_interface_types": "", "accession": "", "organism": "", "component_type": "", "split": ""})


def entry_master(entries: DataFrame, rollups: Sequence[tuple[DataFrame, Sequence[Column]]], key: str) -> DataFrame:
    """Entries joined to per-entry rollups, each aggregated before its join."""
    out = entries
    for rows, aggs in rollups:
        out = out.join(rows.groupBy(key).agg(*aggs), key, "left")
    return out


def fallback_lookup(rows: DataFrame, dims: DataFrame, first_key: str, second_key: str, payload: Sequence[str],
                    ordinal: str, keep: str = "last") -> DataFrame:
    """Whole-row lookup by ``first_key``, else by ``second_key``; ``keep`` picks first or last duplicates."""
    order = [F.col(ordinal).desc() if keep == "last" else F.col(ordinal).asc()]

    def best(key: str, name: str) -> DataFrame:
        kept = first_rows(dims.filter(text(key) != ""), [key], order)
        return kept.select(key, F.struct(*payload).alias(name))

    one, two = best(first_key, "_one"), best(second_key, "_two")
    row = F.coalesce("_one", "_two")
    return rows.join(one, first_key, "left").join(two, second_key, "left").select(
        *rows.columns, *[row[p].alias(p) for p in payload],
        F.when(F.col("_one").isNotNull(), first_key).when(F.col("_two").isNotNull(), second_key)
        .otherwise("none").alias("matched_on"))


def split_assignment(items: DataFrame, item_id: str, examples: DataFrame) -> DataFrame:
    """Item ids resolved to (pair, type): an example id, else ``pair|type`` parsed from the right."""
    tail = F.regexp_extract(item_id, r"^(.*)\|([^|]*)$", 2)
    parsed = items.filter(F.col(item_id).contains("|")).select(
        F.regexp_extract(item_id, r"^(.*)\|([^|]*)$", 1).alias("pair_key"),
        F.when(tail == "assay_unknown", "").otherwise(tail).alias("kind"), "split", F.lit(1).alias("_p"))
    named = items.join(examples.select(F.col("example_id").alias(item_id), "pair_key", "kind"), item_id).select(
        "pair_key", "kind", "split", F.lit(0).alias("_p"))
    return first_rows(named.unionByName(parsed), ["pair_key", "kind"], ["_p", "split"]).drop("_p")


def chain_context(samples: DataFrame, chains: DataFrame, sample_id: str, entry: str, accessions: str) -> DataFrame:
    """Ordered distinct entry chain ids behind a sample's accessions; unchanged when none is known.

    Chain ids of one entry are a short list; the collected array is bounded by it.
    """
    wanted = samples.select(sample_id, entry, F.posexplode(accessions).alias("_pos", "accession"))
    listed = chains.select(entry, "accession", "chain_id").distinct()
    found = wanted.join(listed, [entry, "accession"]).groupBy(sample_id, "chain_id").agg(F.min("_pos").alias("_pos"))
    merged = found.groupBy(sample_id).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_pos", "chain_id"))), lambda s: s["chain_id"]).alias("chain_ids"))
    return samples.join(merged, sample_id, "left")


def annotation_join(rows: DataFrame, by_accession: Sequence[DataFrame], by_entry: Sequence[tuple[DataFrame, str]],
                    accession: str, entry: str, chain: str) -> DataFrame:
    """Annotations by accession, and by entry with the chain's own ids preferred over the entry's.

    Each entry annotation frame has a ``chain_map`` (chain -> ids) and an ``ids`` array.
    """
    out = rows
    for dim in by_accession:
        out = out.join(dim, accession, "left")
    for dim, name in by_entry:
        out = out.join(dim, entry, "left").withColumn(
            name, F.coalesce(F.try_element_at("chain_map", F.col(chain)), F.col("ids"))).drop("chain_map", "ids")
    return out


def tool_merge(tools: Sequence[DataFrame], keys: Sequence[str], targets: dict[str, Sequence[str]], ordinal: str,
               zero_is_missing: bool = True) -> DataFrame:
    """Full outer merge of result tables (last row per key wins); first usable alias per target.

    ``targets`` maps a target to its alias columns in preference order. ``quality`` counts them.
    """
    merged = None
    for tool in tools:
        kept = first_rows(tool, keys, [F.col(ordinal).desc()]).drop(ordinal)
        merged = kept if merged is None else merged.join(kept, list(keys), "full")
    usable = lambda c: F.nullif(F.col(c), F.lit(0.0)) if zero_is_missing else F.col(c)
    picked = [F.coalesce(*[usable(a) for a in aliases]).alias(t) for t, aliases in targets.items()]
    out = merged.select(*keys, *picked)
    present = sum([F.col(t).isNotNull().cast("int") for t in targets], F.lit(0))
    return out.withColumn("quality", F.when(present == len(targets), "complete").when(present > 0, "partial")
                          .otherwise("rejected"))


def refresh_plan(selected: DataFrame, key: str, assets: dict[str, DataFrame]) -> DataFrame:
    """Selected ids with the assets that are missing; priority is high when any is."""
    out = selected.groupBy(key).agg(F.count(F.lit(1)).alias("selected_rows"))
    for name, listing in assets.items():
        out = out.join(listing.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), n) for n in assets]))
    return out.select(key, "selected_rows", F.array_join(missing, ",").alias("missing_assets"),
                      F.when(F.size(missing) > 0, "high").otherwise("normal").alias("priority"))


def identity_crosswalk(pairs: DataFrame, chains: DataFrame, ligands: DataFrame) -> DataFrame:
    """Pair to protein and ligand identities; status exact, partial or unresolved.

    ``pairs`` has pair_key, entry_id, receptor (array) and ligand_key. Pairs are moved once by entry, to the lists of its
    chains and ligands in which they look theirs up, and what they found once by pair key. A list holds the rows of one
    entry, or what one pair key found in its entries.
    """
    asked = pairs.select("pair_key", "entry_id", "receptor", "ligand_key").repartition("entry_id").distinct()
    owned = chains.groupBy("entry_id").agg(F.collect_list(F.struct("ord", "chain_id", "accession")).alias("_chains"))
    keys = F.array_distinct(F.array_compact(F.array(*[blank_to_null(k) for k in ("inchikey", "component_id", "component_name")])))
    held = ligands.groupBy("entry_id").agg(F.collect_list(F.struct("ord", keys.alias("keys"), "inchikey", "component_id")).alias("_ligands"))
    rows = asked.join(owned, "entry_id", "left").join(held, "entry_id", "left")
    last = lambda r: F.array_max(F.filter("_chains", lambda c: c["chain_id"] == r))
    found = F.transform(F.array_distinct("receptor"), lambda r: F.struct(r.alias("chain_id"), last(r).alias("last")))
    named = lambda c: text(c["last"]["accession"]) != ""
    protein_id = lambda c: F.when(named(c), F.concat(F.lit("protein:"), c["last"]["accession"])).otherwise(
        F.concat(F.lit("protein:"), F.col("entry_id"), F.lit(":"), c["chain_id"]))
    first = F.array_min(F.filter("_ligands", lambda o: F.array_contains(o["keys"], F.col("ligand_key"))))
    rows = rows.select("pair_key", "entry_id", "ligand_key", found.alias("_found"), F.coalesce(first, F.array_min("_ligands")).alias("_l"), first.isNotNull().alias("_by_key"))
    ligand_id = (
        F.when(~F.col("_by_key"), F.concat(F.lit("ligand:"), F.col("ligand_key")))
        .when(text("_l.inchikey") != "", F.concat(F.lit("ligand:"), F.col("_l.inchikey")))
        .otherwise(F.concat(F.lit("ligand:"), F.col("_l.component_id"))))
    asks = text("ligand_key") != ""
    rows = rows.select(
        "pair_key", F.transform("_found", protein_id).alias("_ids"), F.forall("_found", named).alias("_all"),
        F.exists("_found", lambda c: c["last"].isNotNull()).alias("_any"), (F.size("_found") > 0).alias("_listed"),
        F.when(asks, F.struct(ligand_id.alias("ligand_id"), (F.col("_by_key") & (text("_l.inchikey") != "")).alias("exact"), "entry_id", "ligand_key")).alias("_ligand")
    )
    per_pair = rows.groupBy("pair_key").agg(
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("_listed"), F.col("_ids")))))), "; ").alias("protein_ids"),
        F.bool_and(F.when(F.col("_listed"), F.col("_all"))).alias("_proteins_exact"), F.bool_or("_any").alias("_any_protein"),
        F.bool_or("_listed").alias("_listed"), F.collect_set("_ligand").alias("_ligands"))
    joined = per_pair.select("pair_key", F.when(F.col("_listed"), F.col("protein_ids")).alias("protein_ids"), "_proteins_exact", "_any_protein",
                             F.explode_outer("_ligands").alias("_ligand"))
    exact = F.coalesce("_proteins_exact", F.lit(False)) & F.coalesce("_ligand.exact", F.lit(True))
    any_side = F.coalesce("_any_protein", F.lit(False)) | F.col("_ligand.ligand_id").isNotNull()
    return joined.select("pair_key", "protein_ids", F.col("_ligand.ligand_id").alias("ligand_id"),
                         F.when(exact, "exact").when(any_side, "partial").otherwise("unresolved").alias("status"))


def identifier_type(c: Column) -> Column:
    return (
        F.when(c.rlike(r"^ENS[A-Z]*[GPT]\d+"), "ensembl").when(c.rlike(r"^\d+$"), "entrez")
        .when(c.rlike(r"^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"), "uniprot")
        .otherwise("gene_symbol"))


def identifier_map(ids: DataFrame, identifier: str, mapping: DataFrame) -> DataFrame:
    """Targets per identifier: one match mapped, several ambiguous (smallest kept), none unmapped."""
    per = mapping.groupBy("source_id", "target_type").agg(F.countDistinct("target_id").alias("_n"),
                                                          F.min("target_id").alias("_best"))
    wide = per.groupBy("source_id").agg(
        *[F.max(F.when(F.col("target_type") == t, F.col("_best"))).alias(t) for t in ("uniprot", "entrez", "ensembl")],
        F.max("_n").alias("_most"), F.count(F.lit(1)).alias("_kinds"))
    joined = ids.join(wide, F.col(identifier) == F.col("source_id"), "left")
    return joined.select(
        identifier, identifier_type(F.col(identifier)).alias("identifier_type"), "uniprot", "entrez", "ensembl",
        F.when(F.col("_kinds").isNull(), "unmapped").when(F.col("_most") > 1, "ambiguous")
        .when(F.col("_kinds") < 3, "partial").otherwise("mapped").alias("status"))


def backfill_pairs(rows: DataFrame, donors: DataFrame, four: Sequence[str], columns: Sequence[str],
                   ordinal: str) -> DataFrame:
    """Blank values filled from a donor with the same four keys (last), else the same first three (first)."""
    exact = first_rows(donors, four, [F.col(ordinal).desc()]).select(*four, F.struct(*columns).alias("_exact"))
    loose = first_rows(donors, four[:3], [F.col(ordinal).asc()]).select(*four[:3], F.struct(*columns).alias("_loose"))
    donor = F.coalesce("_exact", "_loose")
    kept = [c for c in rows.columns if c not in columns]
    return rows.join(exact, list(four), "left").join(loose, list(four[:3]), "left").select(
        *kept, *[F.coalesce(blank_to_null(c), donor[c]).alias(c) for c in columns])


def token_queue(queue: DataFrame, ids: str, keys: Sequence[str], fragments: DataFrame, fragment_key: str) -> DataFrame:
    """Queue batches joined to the fragments of their archetype ids, order kept as a position column."""
    wanted = queue.select(*keys, F.posexplode(ids).alias("position", fragment_key))
    return wanted.join(fragments, fragment_key)


def surrogate_matrix(targets: DataFrame, archetypes: DataFrame, site_features: DataFrame) -> DataFrame:
    """Targets with archetypes (archetype, motif), then site features (site, motif)."""
    return targets.join(archetypes, ["archetype_id", "motif_class"]).join(site_features, ["site_id", "motif_class"])


def training_payload(samples: DataFrame, labels: DataFrame, splits: DataFrame, key: str, label: str) -> DataFrame:
    """Graph samples with label and split (by id or by ``RCSB_`` + id)."""
    both = splits.select(F.regexp_replace("member_id", "^RCSB_", "").alias(key), "split")
    one = top_rows(both, [key], [F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)])
    return samples.join(labels.select(key, label), key, "left").join(one, key, "left").withColumn(
        "split", F.coalesce("split", F.lit("unassigned")))
