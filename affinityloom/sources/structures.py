"""Structure entries and coordinates: nested entry flattening, atom tables, coordinate metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinityloom.functions import classify as C
from affinityloom.functions.structure import METAL_ELEMENTS

ENTRY_SCHEMA = (
    "rcsb_id string, title string, keywords string, method string, resolution array<double>, released string, assembly_count int, "
    "oligomeric_details string, polymer_entities array<struct<entity string, type string, sequence string, chains array<string>, "
    "accessions array<string>, taxa array<int>, description string>>, "
    "nonpolymer_entities array<struct<entity string, component string, name string, chains array<string>>>")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY_SCHEMA).json(path)


def classified(entries: DataFrame) -> DataFrame:
    """Entries with proteins, peptides, bound objects (roles settled) and interfaces as nested lists."""
    kind = lambda e: C.polymer_kind(e["type"], e["sequence"])
    side = lambda k: F.transform(
        F.filter("polymer_entities", lambda e: kind(e) == k), lambda e: F.struct(e["entity"].alias("entity"), e["chains"].alias("chains")))
    objects = F.transform("nonpolymer_entities", lambda o: F.struct(
        o["component"].alias("component"), C.component_kind(o["component"])["binder_type"].alias("binder_type"),
        C.component_kind(o["component"])["role"].alias("role"), o["chains"].alias("chains")))
    out = entries.withColumn("proteins", side("protein")).withColumn("peptides", side("peptide")).withColumn("objects", objects)
    return out.withColumn("objects", C.disambiguated_roles("objects")).withColumn(
        "interfaces", C.interface_pairs("proteins", "peptides"))


def canonical_samples(entries: DataFrame) -> DataFrame:
    """Entry to sample: first protein receives, second is partner (protein pairs only), first small
    molecule is the ligand; id and taxonomy unions."""
    rows = classified(entries)
    poly = F.filter("polymer_entities", lambda e: C.polymer_kind(e["type"], e["sequence"]) == "protein")
    small = F.filter("objects", lambda o: o["binder_type"] == "small_molecule")
    at = lambda a, i: F.try_element_at(a, F.lit(i))
    task = C.task_hint(F.size(poly), F.size(small))
    return rows.select(
        F.concat(F.lit("RCSB_"), F.col("rcsb_id")).alias("sample_id"), F.col("rcsb_id").alias("entry_id"), task.alias("task"),
        at(poly, 1)["sequence"].alias("receptor_sequence"), at(poly, 1)["chains"].alias("receptor_chains"),
        F.when(task == "protein_protein", at(poly, 2)["sequence"]).alias("partner_sequence"),
        F.when(F.size(small) > 0, at(small, 1)["component"]).alias("ligand_id"),
        F.sort_array(F.array_distinct(F.flatten(F.transform(poly, lambda e: e["accessions"])))).alias("accessions"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("polymer_entities", lambda e: e["taxa"])))).alias("taxa"),
        at(F.col("resolution"), 1).alias("resolution"))


def entry_tables(entries: DataFrame) -> dict[str, DataFrame]:
    """Entry, chain, bound-object and interface tables from one classified frame."""
    rows = classified(entries)
    poly = rows.select("rcsb_id", F.explode("polymer_entities").alias("e"))
    return {
        "entry": rows.select(
            "rcsb_id", "method", F.try_element_at("resolution", F.lit(1)).alias("resolution"), F.size("proteins").alias("protein_count"),
            C.oligomeric_state(F.transform("proteins", lambda p: p["chains"])).alias("oligomeric_state"),
            C.membrane_context("keywords", "title").alias("membrane")),
        "chains": poly.select(
            "rcsb_id", F.explode("e.chains").alias("chain_id"), F.col("e.entity").alias("entity"),
            C.polymer_kind(F.col("e.type"), F.col("e.sequence")).alias("kind"), F.try_element_at("e.accessions", F.lit(1)).alias("accession")),
        "bound_objects": rows.select("rcsb_id", F.posexplode("objects").alias("ordinal", "o")).select(
            "rcsb_id", "ordinal", F.col("o.component").alias("component"), F.col("o.binder_type").alias("binder_type"), F.col("o.role").alias("role")),
        "interfaces": rows.select("rcsb_id", F.posexplode("interfaces").alias("ordinal", "f")).select("rcsb_id", "ordinal", "f.*"),
        "provenance": rows.select("rcsb_id", F.explode(F.array(
            F.struct(F.lit("method").alias("field"), F.col("method").isNotNull().alias("known")),
            F.struct(F.lit("resolution").alias("field"), (F.size("resolution") > 0).alias("known")))).alias("p")).select(
            "rcsb_id", "p.field", F.when(F.col("p.known"), "high").otherwise("unknown").alias("confidence")),
    }


def supplement(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """Parsed entities (entry, entity, kind) added only where the metadata view lacks them."""
    return entries.unionByName(parsed.join(entries.select("entry_id", "entity"), ["entry_id", "entity"], "left_anti"))


def _cut(c: Column, start: int, length: int) -> Column:
    return F.trim(F.substring(c, start, length))


def pdb_atoms(lines: DataFrame, structure: str, value: str = "value") -> DataFrame:
    """Atom table from fixed-column coordinate lines."""
    v = F.col(value)
    rows = lines.filter(v.startswith("ATOM") | v.startswith("HETATM"))
    return _atom_table(rows.select(
        structure, v.startswith("HETATM").alias("hetero"), _cut(v, 13, 4).alias("atom"), _cut(v, 17, 1).alias("alt"), _cut(v, 18, 3).alias("residue"),
        _cut(v, 22, 1).alias("chain"), _cut(v, 23, 4).try_cast("int").alias("number"), _cut(v, 31, 8).try_cast("double").alias("x"),
        _cut(v, 39, 8).try_cast("double").alias("y"), _cut(v, 47, 8).try_cast("double").alias("z"),
        _cut(v, 55, 6).try_cast("double").alias("occupancy"), _cut(v, 61, 6).try_cast("double").alias("b_factor"), _cut(v, 77, 2).alias("element")))


def cif_atoms(lines: DataFrame, structure: str, line_no: str, value: str = "value") -> DataFrame:
    """Atom table from the atom-site loop: its header lines give the column order per structure."""
    v = F.col(value)
    heads = lines.filter(v.startswith("_atom_site.")).select(structure, F.trim(F.substr(v, F.lit(12))).alias("name"), line_no)
    first = heads.groupBy(structure).agg(F.min(line_no).alias("_first"))
    order = heads.join(first, structure).groupBy(structure).agg(
        F.map_from_entries(F.collect_list(F.struct("name", (F.col(line_no) - F.col("_first") + 1).cast("int").alias("i")))).alias("_at"))
    quoted = r"""'[^']*'(?=\s|$)|"[^"]*"(?=\s|$)|\S+"""
    rows = lines.filter(v.startswith("ATOM ") | v.startswith("HETATM ")).select(
        structure, F.regexp_extract_all(v, F.lit(quoted), F.lit(0)).alias("_f")).join(order, structure)

    def field(name: str) -> Column:
        raw = F.try_element_at("_f", F.try_element_at("_at", F.lit(name)))
        return F.regexp_replace(raw, "^[\"']|[\"']$", "")

    return _atom_table(rows.select(
        structure, (field("group_PDB") == "HETATM").alias("hetero"), field("label_atom_id").alias("atom"),
        F.when(field("label_alt_id").isin(".", "?"), "").otherwise(field("label_alt_id")).alias("alt"), field("label_comp_id").alias("residue"),
        field("auth_asym_id").alias("chain"), field("auth_seq_id").try_cast("int").alias("number"), field("Cartn_x").try_cast("double").alias("x"),
        field("Cartn_y").try_cast("double").alias("y"), field("Cartn_z").try_cast("double").alias("z"),
        field("occupancy").try_cast("double").alias("occupancy"), field("B_iso_or_equiv").try_cast("double").alias("b_factor"),
        field("type_symbol").alias("element")))


def _atom_table(rows: DataFrame) -> DataFrame:
    element = F.upper(F.coalesce(F.nullif("element", F.lit("")), F.substring("atom", 1, 1)))
    return rows.withColumn("element", element).withColumn("is_heavy", ~F.col("element").isin("H", "D")).withColumn(
        "is_metal", F.col("residue").isin(METAL_ELEMENTS))


def residue_centroids(atoms: DataFrame, structure: str) -> DataFrame:
    """Mean coordinates per residue."""
    return atoms.groupBy(structure, "chain", "number", "residue").agg(*[F.avg(c).alias(c) for c in ("x", "y", "z")])


def coordinate_metadata(atoms: DataFrame, structure: str) -> DataFrame:
    """Atom and water counts, distinct hetero instances, alternate-location and partial-occupancy flags."""
    water = F.col("residue").isin("HOH", "WAT", "DOD")
    counts = atoms.groupBy(structure).agg(
        F.count(F.lit(1)).alias("atom_count"), F.count_if(water).alias("water_count"),
        F.coalesce(F.bool_or(F.col("alt") != ""), F.lit(False)).alias("has_alternates"),
        F.coalesce(F.bool_or(F.col("occupancy") < 1.0), F.lit(False)).alias("has_partial_occupancy"))
    instances = atoms.filter(F.col("hetero") & ~water).select(structure, "chain", "number", "residue").distinct().groupBy(structure).agg(
        F.count(F.lit(1)).alias("instance_count"))
    return counts.join(instances, structure, "left").na.fill(0, ["instance_count"])


def read_coordinate_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of coordinate files; a file's lines stay numbered in order."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
