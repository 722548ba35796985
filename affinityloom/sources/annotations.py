"""Annotation scans: protein records, pathways, fold domains, domain mappings, predicted models, descriptors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinityloom.operators.ordering import first_rows


def read_flat_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a flat file whose records end in a ``//`` line."""
    return spark.read.option("lineSep", "\n//\n").text(path).withColumnRenamed("value", "record")


def protein_records(records: DataFrame, record: str = "record") -> DataFrame:
    """First accession, name, genes, organism, taxonomy, cross-references, keywords and sequence."""
    lines = F.split(F.col(record), "\n")
    out = records.withColumn("_l", lines)

    def tagged(tag: str) -> Column:
        return F.filter("_l", lambda x: x.startswith(tag))

    def refs(database: str) -> Column:
        hits = F.filter(tagged("DR   "), lambda x: F.trim(F.split(F.substr(x, F.lit(6)), ";")[0]) == database)
        return F.sort_array(F.array_distinct(F.transform(hits, lambda x: F.trim(F.split(F.substr(x, F.lit(6)), ";")[1]))))

    genes = F.transform(tagged("GN   Name="), lambda x: F.trim(F.split(F.split(x, "Name=")[1], ";")[0]))
    words = F.flatten(F.transform(tagged("KW   "), lambda x: F.transform(
        F.filter(F.split(F.substr(x, F.lit(6)), ";"), lambda w: F.trim(w) != ""), lambda w: F.rtrim(F.trim(w), F.lit(".")))))
    after_sq = F.slice("_l", F.array_position(F.transform("_l", lambda x: x.startswith("SQ   SEQUENCE")), F.lit(True)).cast("int") + 1,
                       F.size("_l"))
    sequence = F.regexp_replace(F.array_join(F.filter(after_sq, lambda x: x.startswith(" ")), ""), r"\s", "")
    has_sq = F.exists("_l", lambda x: x.startswith("SQ   SEQUENCE"))
    first = lambda a: F.try_element_at(a, F.lit(1))
    parsed = out.select(
        F.upper(F.trim(F.split(F.substr(first(tagged("AC   ")), F.lit(6)), ";")[0])).alias("accession"),
        F.trim(F.rtrim(F.split(first(tagged("DE   RecName: Full=")), "Full=")[1], F.lit(";"))).alias("protein_name"),
        F.sort_array(F.array_distinct(F.filter(genes, lambda g: g != ""))).alias("genes"),
        F.array_join(F.transform(tagged("OS   "), lambda x: F.trim(F.substr(x, F.lit(6)))), " ").alias("organism"),
        F.trim(F.split(F.split(first(tagged("OX   NCBI_TaxID=")), "NCBI_TaxID=")[1], ";")[0]).try_cast("bigint").alias("taxonomy_id"),
        refs("PDB").alias("entry_ids"), refs("InterPro").alias("interpro_ids"), refs("Pfam").alias("pfam_ids"), refs("GO").alias("go_terms"),
        F.sort_array(F.array_distinct(words)).alias("keywords"),
        F.when(has_sq, sequence).otherwise("").alias("sequence"))
    return parsed.filter(F.coalesce("accession", F.lit("")) != "").withColumn("sequence_length", F.length("sequence"))


def pathway_rollup(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Pathways and species per accession from (accession, pathway, name, species) rows.

    A protein's pathways are a short curated list; it is deduplicated before it is collected.
    """
    named = rows if names is None else rows.join(names.select("pathway", F.col("name").alias("_n")), "pathway", "left").withColumn(
        "name", F.coalesce("_n", "name")).drop("_n")
    distinct = named.groupBy("accession", "pathway").agg(F.min("name").alias("name"), F.collect_set("species").alias("species"))
    return distinct.groupBy("accession").agg(
        F.sort_array(F.collect_list(F.struct(F.col("pathway").alias("id"), "name"))).alias("pathways"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("species")))).alias("species"))


def cath_classes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Domain instance -> c.a.t.h code."""
    p = F.filter(F.split(F.trim(F.col(value)), r"\s+"), lambda x: x != "")
    return lines.filter(~F.ltrim(F.col(value)).startswith("#") & (F.size(p) >= 5)).select(
        p[0].alias("instance"), F.array_join(F.slice(p, 2, 4), ".").alias("domain_id"))


def cath_boundaries(lines: DataFrame, value: str = "value") -> DataFrame:
    """Boundary lines -> (instance, entry, chain). Instance = prefix + two-digit domain number from zero."""
    p = F.filter(F.split(F.trim(F.col(value)), r"\s+"), lambda x: x != "")
    number = F.greatest(F.substr(p[1], F.lit(2)).try_cast("int") - 1, F.lit(0))
    return lines.filter(~F.ltrim(F.col(value)).startswith("#") & (F.size(p) >= 5)).select(
        F.concat(p[0], F.format_string("%02d", number)).alias("instance"), F.upper(F.substring(p[0], 1, 4)).alias("entry_id"),
        p[4].alias("chain_id"))


# How specific a fold description is.
SCOP_LEVELS = {"dm": 0, "sp": 0, "cl": 1, "cf": 2, "sf": 3, "fa": 4}


def scop_names(lines: DataFrame, value: str = "value") -> DataFrame:
    """Name per fold code: the most specific level, first line among equals."""
    p = F.split(F.trim(F.col(value)), "\t")
    level = None
    for name, score in SCOP_LEVELS.items():
        level = F.when(F.trim(p[1]) == name, score) if level is None else level.when(F.trim(p[1]) == name, score)
    rows = lines.filter(~F.ltrim(F.col(value)).startswith("#") & (F.size(p) >= 5)).select(
        F.trim(p[2]).alias("domain_id"), F.trim(p[4]).alias("name"), level.alias("level"), "ord")
    rows = rows.filter((F.col("domain_id") != "") & (F.col("name") != "") & F.col("level").isNotNull())
    return first_rows(rows, ["domain_id"], [F.col("level").desc(), F.col("ord")]).select("domain_id", "name")


def scop_domains(lines: DataFrame, value: str = "value") -> DataFrame:
    """(entry, chain, domain): chain ids from the region text, ``-`` when it names none."""
    p = F.split(F.trim(F.col(value)), "\t")
    tokens = F.filter(F.transform(F.split(p[2], ","), lambda r: F.trim(F.split(F.trim(r), ":")[0])), lambda c: c != "")
    chains = F.when(F.size(tokens) > 0, F.array_distinct(tokens)).otherwise(F.array(F.lit("-")))
    return lines.filter(~F.ltrim(F.col(value)).startswith("#") & (F.size(p) >= 4) & (F.trim(p[0]) != "") & (F.trim(p[3]) != "")).select(
        F.trim(p[0]).alias("instance"), F.upper(F.trim(p[1])).alias("entry_id"), F.explode(chains).alias("chain_id"),
        F.trim(p[3]).alias("domain_id"))


def domain_rollup(domains: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per entry: sorted domain ids, names, chains, and chain -> ids map (entry-sized lists)."""
    rows = domains if names is None else domains.join(names, "domain_id", "left")
    if names is None and "name" not in rows.columns:
        rows = rows.withColumn("name", F.lit(None).cast("string"))
    per_chain = rows.groupBy("entry_id", "chain_id").agg(
        F.sort_array(F.collect_set("domain_id")).alias("ids"), F.collect_set("name").alias("names"))
    return per_chain.groupBy("entry_id").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("domain_ids"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("names")))).alias("domain_names"),
        F.sort_array(F.collect_list("chain_id")).alias("chain_ids"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("chain_id", "ids")))).alias("chain_map"))


MAPPING_SCHEMA = "map<string, struct<name string, description string, mappings array<struct<chain_id string, struct_asym_id string>>>>"


def domain_mappings(df: DataFrame, entry: str, payload: str) -> DataFrame:
    """(entry, domain, name, chain) rows from a domain id -> payload -> mappings response."""
    flat = df.select(entry, F.explode(F.from_json(payload, MAPPING_SCHEMA)).alias("domain_id", "p"))
    return flat.select(
        F.upper(F.col(entry)).alias("entry_id"), "domain_id", F.coalesce("p.name", "p.description").alias("name"),
        F.explode_outer("p.mappings").alias("m")).select(
        "entry_id", "domain_id", "name", F.coalesce("m.chain_id", "m.struct_asym_id").alias("chain_id"))


def predicted_members(listing: DataFrame, member: str) -> DataFrame:
    """Accession, entry id and model version of predicted-structure members; others drop out."""
    base = F.element_at(F.split(F.col(member), "/"), -1)
    return listing.filter(base.startswith("AF-") & base.contains("-model_")).select(
        F.upper(F.split(base, "-")[1]).alias("accession"), F.regexp_replace(base, r"(\.pdb|\.cif)(\.gz)?$", "").alias("model_entry"),
        F.split(F.split(base, "model_")[1], r"\.")[0].alias("version"), "size", F.col(member).alias("member"))


def component_descriptors(df: DataFrame, component: str, descriptors: str) -> DataFrame:
    """Descriptor map per component: later values of a type win; SMILES defaults to the canonical one."""
    flat = df.select(component, F.posexplode(descriptors).alias("_p", "_d")).select(
        component, "_p", F.col("_d.type").alias("type"), F.col("_d.value").alias("value"))
    last = first_rows(flat.filter("value IS NOT NULL"), [component, "type"], [F.col("_p").desc()])
    mapped = last.groupBy(component).agg(F.map_from_entries(F.collect_list(F.struct("type", "value"))).alias("d"))
    return mapped.select(
        component, F.col("d")["InChIKey"].alias("inchikey"), F.col("d")["SMILES_CANONICAL"].alias("smiles_canonical"),
        F.coalesce(F.col("d")["SMILES"], F.col("d")["SMILES_CANONICAL"]).alias("smiles"))
