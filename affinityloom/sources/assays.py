"""Assay source normalisers: each turns one source's rows into the common sample columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.functions import affinity as A
from affinityloom.functions.text import blank_to_null, first_text, site_residue_tokens, text

# Columns of the binding-site table when it has no header.
SITE_COLUMNS = [
    "pdb_id", "receptor_chain", "resolution", "binding_site_residues", "ligand_chain", "ligand_id", "ligand_serial",
    "binding_affinity", "binding_affinity_manual", "catalytic_site_residues", "ec_number", "go_terms", "pubmed_id"]
# Names under which a header may give them.
SITE_NAMES = {
    "pdb_id": ["pdb_id", "pdb"], "receptor_chain": ["receptor_chain", "protein_chain", "chain"], "resolution": ["resolution"],
    "binding_site_residues": ["binding_site_residues"], "ligand_chain": ["ligand_chain"], "ligand_id": ["ligand_id", "ligand_id_ligand"],
    "ligand_serial": ["ligand_serial", "ligand_serial_number"], "affinity": ["binding_affinity", "binding_affinity_manual", "affinity"],
    "catalytic_site_residues": ["catalytic_site_residues"], "ec_number": ["ec_number"], "go_terms": ["go_terms"], "pubmed_id": ["pubmed_id", "pmid"]}


GIVEN_DDG = "ddG (kcal/mol)"


def mutation_rows(rows: DataFrame) -> DataFrame:
    """ddG rows of the mutation table; rows without entry id or mutation drop out.

    A number in the table's own ddG column, where it has one, goes before the computed value.
    """
    entry = F.split(F.col("#Pdb"), "_")[0]
    computed = A.ddg("affinity_mut (M)", "affinity_wt (M)", "Temperature")
    ddg = F.coalesce(F.trim(F.col(GIVEN_DDG)).try_cast("double"), computed) if GIVEN_DDG in rows.columns else computed
    return rows.filter((text("#Pdb") != "") & (text("Mutation(s)_cleaned") != "")).select(
        F.upper(entry).alias("entry_id"), F.trim("Mutation(s)_cleaned").alias("mutation"),
        ddg.alias("ddg"),
        A.celsius("Temperature").alias("temperature_c"), F.lit("ddG").alias("kind"))


def index_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Affinity index text: whitespace tokens, ``//`` reference tail, last token that is an affinity."""
    stripped = F.trim(F.col(value))
    head = F.split(stripped, "//", 2)[0]
    tokens = F.filter(F.split(head, r"\s+"), lambda t: t != "")
    affinity = F.element_at(F.filter(tokens, lambda t: t.rlike(A.INDEX_TOKEN)), -1)
    kept = lines.filter((stripped != "") & ~stripped.startswith("#") & (F.size(tokens) >= 4)
                        & F.exists(tokens, lambda t: t.rlike(A.INDEX_TOKEN)))
    parsed = A.parse_affinity_token(affinity)
    return kept.select(
        F.upper(tokens[0]).alias("entry_id"), tokens[1].try_cast("double").alias("resolution"),
        tokens[2].try_cast("int").alias("release_year"), affinity.alias("raw_affinity"), parsed["kind"].alias("kind"),
        parsed["relation"].alias("relation"), parsed["value"].alias("value"), parsed["unit"].alias("unit"),
        parsed["standardized"].alias("standardized"),
        F.when(stripped.contains("//"), F.trim(F.split(stripped, "//", 2)[1])).alias("reference"))


def _site_name(name: str) -> str:
    """A header's name with blanks, hyphens and slashes as underscores, without brackets, in lower case."""
    return name.strip().lower().translate(str.maketrans({" ": "_", "-": "_", "/": "_", "(": None, ")": None}))


def _usable(lines: DataFrame, value: str) -> DataFrame:
    return lines.filter((F.trim(F.col(value)) != "") & ~F.ltrim(F.col(value)).startswith("#"))


def site_header(lines: DataFrame, value: str = "value") -> list[str] | None:
    """The names of the header line, None where the first line isn't one."""
    first = _usable(lines, value).limit(1).collect()
    names = [_site_name(p) for p in first[0][value].split("\t")] if first else []
    return names if any("pdb" in n for n in names) else None


def has_site_header(lines: DataFrame, value: str = "value") -> bool:
    return site_header(lines, value) is not None


def site_lines(lines: DataFrame, header: bool, value: str = "value") -> DataFrame:
    """Binding-site rows: affinity and residue lists per (entry, receptor chain, ligand).

    Whether the first line is a header is decided once by the caller (``has_site_header``). With a header, values are
    found by its names, whatever their order; without one, by their places. The first affinity given counts.
    """
    names = (site_header(lines, value) if header else None) or SITE_COLUMNS
    parts = F.split(F.col(value), "\t")
    at = {name: F.trim(F.coalesce(F.try_element_at(parts, F.lit(i + 1)), F.lit(""))) for i, name in enumerate(names)}
    known = {c: first_text(*[at[n] for n in named if n in at], F.lit("")) for c, named in SITE_NAMES.items()}
    rows = _usable(lines, value).select(*[F.coalesce(v, F.lit("")).alias(c) for c, v in known.items()])
    if header:
        rows = rows.filter(~F.lower("pdb_id").isin("pdb_id", "pdb id", "pdbid", "pdb"))
    parsed = A.parse_site_affinity("affinity")
    blank = lambda c: blank_to_null(c).alias(c)
    return rows.select(
        F.upper("pdb_id").alias("entry_id"),
        F.col("receptor_chain").alias("chain_id"), F.col("resolution").try_cast("double").alias("resolution"), "ligand_id",
        blank("ligand_chain"), blank("ligand_serial"), site_residue_tokens("binding_site_residues").alias("residues"),
        site_residue_tokens("catalytic_site_residues").alias("catalytic_residues"), blank("ec_number"), blank("go_terms"), blank("pubmed_id"),
        parsed["kind"].alias("kind"), parsed["value"].alias("value"), parsed["unit"].alias("unit"), parsed["standardized"].alias("standardized"),
        F.when((parsed["standardized"] > 0) & (parsed["kind"] != "dG"), F.round(F.log10(parsed["standardized"]), 6)).alias("log10"))


# Spellings of the nested response's keys; the first that is given counts.
SPELLINGS = {
    "smiles": ["smiles", "Smiles"], "ligand_id": ["cid", "monomerID"], "ligand_name": ["name", "monomerName"],
    "affinity": ["affinity", "Affinity", "value", "Value"], "unit": ["affinityUnit", "AffinityUnit", "unit", "Unit"],
    "kind": ["affinityType", "AffinityType"], "target": ["target", "Target", "targetName"], "accession": ["uniprotID", "uniprot_primary_id"],
    "pubmed_id": ["pubmedId", "PubMedID", "pmid", "PMID"], "doi": ["doi", "DOI"], "mutation": ["mutation", "Mutation", "mutationString", "MutationString"],
    "temperature": ["temperature", "Temperature"], "ph": ["pH", "ph", "PH"], "chains": ["chainIDs", "chainIds", "chainId", "ChainIDs", "ChainId"]}
ENTRIES = "array<map<string, string>>"


def nested_affinities(df: DataFrame, entry: str, payload: str) -> DataFrame:
    """One row per monomer and affinity of a nested response, whatever spelling its keys have.

    Entries are read as maps, so spellings that differ by case alone stay apart; one parse per level.
    """
    pick = lambda c, name: F.coalesce(*[F.try_element_at(c, F.lit(k)) for k in SPELLINGS[name]])
    mono = df.select(entry, F.explode(F.from_json(payload, ENTRIES)).alias("m"))
    flat = mono.select(
        entry, *[pick(F.col("m"), n).alias(n) for n in ("ligand_id", "smiles", "ligand_name")],
        F.explode(F.from_json(F.try_element_at("m", F.lit("affinities")), ENTRIES)).alias("a"))
    named = flat.select(entry, "ligand_id", "smiles", "ligand_name", *[
        pick(F.col("a"), n).alias(n) for n in SPELLINGS if n not in ("ligand_id", "smiles", "ligand_name")])
    parsed = A.parse_affinity("affinity", "unit")
    chains = F.filter(F.transform(F.split(F.replace(F.col("chains"), F.lit(";"), F.lit(",")), ","), F.trim), lambda x: x != "")
    return named.select(
        entry, "ligand_id", "smiles", "ligand_name", "kind", "accession", "target", "pubmed_id", "doi", "mutation",
        F.col("temperature").try_cast("double").alias("temperature_c"), F.col("ph").try_cast("double").alias("ph"),
        F.when(F.size(chains) > 0, chains).alias("receptor_chains"),
        parsed["value"].alias("value"), parsed["relation"].alias("relation"), parsed["standardized"].alias("standardized"),
        parsed["log10"].alias("log10"))


def bulk_samples(rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Joined bulk rows to samples: nM value, relation from the display text, mutation from the target
    name, accession union, sample id; columns named in ``carry`` stay."""
    shown = first_text("affinity_display", F.col("affinity_nm").cast("string"))
    number = F.coalesce(A.numeric_text(shown), F.col("affinity_nm").cast("double"))
    found = F.sort_array(F.array_distinct(F.regexp_extract_all(F.coalesce("target_name", F.lit("")), F.lit(A.MUTATION_TOKEN), F.lit(0))))
    ids = F.array_distinct(F.filter(
        F.transform(F.split(F.concat_ws(",", "accession_1", "accession_2"), "[;,]"), lambda x: F.trim(x)),
        lambda x: (x != "") & (F.lower(x) != "null")))
    return rows.select(
        F.concat_ws("_", F.lit("BDB_BULK"), "entry_id", "set_id", "monomer_id", "kind").alias("sample_id"), "entry_id", "kind",
        number.alias("value"), A.relation_prefix(shown).alias("relation"),
        F.when(number > 0, F.round(F.log10(number), 6)).alias("log10"),
        F.when(F.size(found) > 0, F.array_join(found, ",")).alias("mutation"),
        F.when(F.size(found) > 0, "mutant").otherwise("wildtype").alias("state"), F.array_join(ids, ";").alias("accessions"), *carry)


def activity_samples(rows: DataFrame) -> DataFrame:
    """Activity rows to samples; an unknown mutation context gets its own grouping override."""
    kind = A.activity_type("standard_type")
    number = F.col("standard_value").try_cast("double")
    standard = F.round(number * A.unit_factor("standard_units"), 6)
    log10 = F.when(kind != "dG", F.coalesce(
        F.when(standard > 0, F.round(F.log10(standard), 6)), F.round(9.0 - blank_to_null("pchembl_value").try_cast("double"), 6)))
    note = A.mutation_annotation("assay_description", "activity_comment", "target_name")
    out = rows.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("_m", note)
    unknown = F.col("_m.mutation").isNull() & F.col("_m.state").isNull() & (text("activity_id") != "")
    return out.select(
        F.concat(F.lit("CHEMBL_"), F.col("activity_id")).alias("sample_id"), "accession", "inchikey", "kind", number.alias("value"),
        standard.alias("standardized"), log10.alias("log10"), F.col("_m.mutation").alias("mutation"), F.col("_m.state").alias("state"),
        F.when(unknown, F.concat(F.lit("protein_ligand|-|-|"), F.col("inchikey"), F.lit("|mutation_unknown:"), F.col("activity_id"))).alias("grouping_override"))


# Possessive repeats: a match neither backtracks nor recurses, however long a quoted text is.
TUPLE = r"\((?:[^()']++|'(?:[^'\\]++|\\.)*+')*+\)"
FIELD = r"[(,]\s*('(?:[^'\\]++|\\.)*+'|[^,')]*)"


def unescaped(field: Column) -> Column:
    """Quoted text without quotes and escapes; bare NULL becomes null."""
    mark = "\u0001"
    inner = F.substr(field, F.lit(2), F.length(field) - 2)
    body = F.replace(inner, F.lit("\\\\"), F.lit(mark))
    for code, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\0"), ("\\b", "\b"), ("\\Z", "\x1a"), ("\\'", "'"), ('\\"', '"')):
        body = F.replace(body, F.lit(code), F.lit(char))
    bare = F.trim(field)
    return F.when(field.startswith("'"), F.replace(body, F.lit(mark), F.lit("\\"))).when(F.upper(bare) != "NULL", bare)


def dump_rows(lines: DataFrame, name: str, ordinals: dict[str, int], value: str = "value") -> DataFrame:
    """Rows of one table of a SQL dump: insert lines, quoted tuples, fields picked by position."""
    opening = f"INSERT INTO `{name}` VALUES "
    kept = lines.filter(F.col(value).startswith(opening))
    tuples = kept.select(F.explode(F.regexp_extract_all(value, F.lit(TUPLE), F.lit(0))).alias("_t"))
    fields = tuples.select(F.regexp_extract_all("_t", F.lit(FIELD), F.lit(1)).alias("_f"))
    return fields.select(*[unescaped(F.try_element_at("_f", F.lit(i + 1))).alias(c) for c, i in ordinals.items()])


def int_tokens(c: Column | str) -> Column:
    """Integers of a delimited list, distinct and sorted."""
    parts = F.transform(F.split(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), "[;,]"), lambda x: F.trim(x).try_cast("bigint"))
    return F.sort_array(F.array_distinct(F.array_compact(parts)))
