"""Unified metadata per pair, and the choice of entry ids that a job runs over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.functions.text import text
from affinityloom.operators.ordering import first_rows, with_position

PREVIEW = 24
#: Columns that may hold an entry id in a listing, the first filled one counts.
ID_COLUMNS = ("pdb_id", "structure_id", "source_record_id", "pdb")


def _tokens(c: str) -> Column:
    """Trimmed parts of a list text split at comma or semicolon, without blanks."""
    return F.filter(F.transform(F.split(text(c), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def _pick(*cs: Column) -> Column:
    """The first text that isn't null or empty, else ''."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs], F.lit(""))


def pairs_from_assays(assays: DataFrame, entries: DataFrame) -> DataFrame:
    """Pair rows where no pair table exists: assay columns, with organism, method and resolution of the entry.

    ``assays`` has entry_id, ord, pair_key, source, kind, value, mean, receptor_chains, receptor_accessions, organisms,
    ligand_types, interface_types and mutations; ``entries`` one row per entry_id. A missing chain list is chain A, a
    missing source RCSB, a missing value the reported mean.
    """
    own = entries.select("entry_id", F.col("organisms").alias("_organisms"), "method", "resolution")
    return assays.join(own, "entry_id", "left").select(
        "entry_id", "ord", text("pair_key").alias("pair_key"), _pick(F.col("source"), F.lit("RCSB")).alias("source"),
        text("kind").alias("kind"), _pick(F.col("value"), F.col("mean")).alias("value"),
        _pick(F.col("receptor_chains"), F.lit("A")).alias("receptor_chains"), text("receptor_accessions").alias("receptor_accessions"),
        _pick(F.col("organisms"), F.col("_organisms")).alias("organisms"), text("ligand_types").alias("ligand_types"),
        text("interface_types").alias("interface_types"), text("method").alias("method"), text("resolution").alias("resolution"),
        text("mutations").alias("mutations"), F.lit("").alias("release_split"))


def _receptor_chains(tokens: Column) -> Column:
    """(sequence, accession) of the listed chains that exist, in list order, from the entry's list ``_chains``.

    The last row of a chain counts. A chain that is listed twice is counted twice.
    """
    last = lambda t: F.array_max(F.filter("_chains", lambda c: c["chain_id"] == t))
    return F.filter(F.transform(tokens, last), lambda c: c.isNotNull())


def _domain_ids(tokens: Column, listed: str) -> Column:
    """Ids of the listed chains in list order, else those of the whole entry, from the entry's list ``listed``.

    Its items have chain_id (null or empty: of the whole entry), id and ord.
    """
    of_chain = F.flatten(F.transform(tokens, lambda t, i: F.transform(F.filter(listed, lambda d: d["chain_id"] == t), lambda d: F.struct(
        i.alias("at"), d["ord"].alias("ord"), d["id"].alias("id")))))
    of_entry = F.transform(F.filter(listed, lambda d: text(d["chain_id"]) == ""), lambda d: F.struct(F.lit(0).alias("at"), d["ord"].alias("ord"), d["id"].alias("id")))
    chosen = F.when(F.size(of_chain) > 0, of_chain).otherwise(of_entry)
    # sorted by place, so the first of equal ids stays
    return F.coalesce(F.array_distinct(F.transform(F.sort_array(chosen), lambda d: d["id"])), F.array().cast("array<string>"))


def unified_metadata(pairs: DataFrame, entries: DataFrame, chains: DataFrame, proteins: DataFrame, cath: DataFrame, scop: DataFrame) -> DataFrame:
    """One metadata row per pair row with an entry id: sequence, accession, organism, fold and protein annotation.

    ``pairs`` as of ``pairs_from_assays``; ``entries`` has entry_id, ord, organisms, method, resolution and oligomer
    (the last row of an id counts); ``proteins`` accession, protein_name, genes (array), reviewed and length; ``cath``
    and ``scop`` as of ``_domain_ids``. The fold is the CATH ids, else the SCOP ids, else the oligomeric state. Fields
    without a value are ''; ``reviewed`` is '' where the protein isn't known. Null lists count as empty. Pair rows are moved
    once, by entry, to the lists of its chains and domains, in which they look theirs up; a list holds the rows of one entry.
    """
    pairs = pairs.where(text("entry_id") != "").withColumn("receptor_chains", text("receptor_chains"))
    last = entries.groupBy("entry_id").agg(F.max_by(F.struct(
        F.col("organisms").alias("e_organisms"), F.col("method").alias("e_method"), F.col("resolution").alias("e_resolution"), "oligomer"), "ord").alias("e"))
    owned = chains.where(text("chain_id") != "").groupBy("entry_id").agg(F.collect_list(F.struct(
        "ord", "chain_id", text("sequence").alias("sequence"), F.trim(text("accession")).alias("accession"))).alias("_chains"))
    joined = pairs.join(last, "entry_id", "left").select(*pairs.columns, "e.*").join(owned, "entry_id", "left")
    for annotation, name in ((cath, "_cath"), (scop, "_scop")):
        listed = annotation.where(text("id") != "").groupBy("entry_id").agg(F.collect_list(F.struct("chain_id", "ord", "id")).alias(name))
        joined = joined.join(listed, "entry_id", "left")
    tokens = _tokens("receptor_chains")
    joined = joined.withColumn("_listed", _receptor_chains(tokens)).withColumns({"cath_ids": _domain_ids(tokens, "_cath"), "scop_ids": _domain_ids(tokens, "_scop")})
    with_sequence = F.filter("_listed", lambda c: c["sequence"] != "")
    joined = joined.withColumns({
        "sequence": F.try_element_at(with_sequence, F.lit(1))["sequence"], "sequence_count": F.coalesce(F.size(with_sequence), F.lit(0)).cast("bigint"),
        "accessions": F.filter(F.transform("_listed", lambda c: c["accession"]), lambda a: a != "")}).drop("_chains", "_cath", "_scop", "_listed")
    accessions = F.array_join(F.array_distinct("accessions"), "; ")
    row = joined.select(
        "entry_id", "ord", text("pair_key").alias("pair_key"), _pick(F.col("receptor_accessions"), accessions).alias("accessions"),
        _pick(F.col("organisms"), F.col("e_organisms")).alias("organism"), _pick(F.col("resolution"), F.col("e_resolution")).alias("resolution"),
        text("value").alias("value"), text("kind").alias("kind"), text("receptor_accessions").alias("protein_family"),
        text("interface_types").alias("interface_type"), text("ligand_types").alias("ligand_class"),
        _pick(F.col("method"), F.col("e_method")).alias("method"), text("sequence").alias("sequence"),
        F.coalesce("sequence_count", F.lit(0)).alias("sequence_count"), text("mutations").alias("mutations"), text("source").alias("source"),
        text("release_split").alias("release_split"), F.array_join("cath_ids", "; ").alias("cath_ids"), F.array_join("scop_ids", "; ").alias("scop_ids"), "oligomer")
    row = row.withColumn("accession", F.coalesce(F.try_element_at(_tokens("accessions"), F.lit(1)), F.lit("")))
    known = first_rows(proteins, ["accession"], ["protein_name"]).select(
        "accession", "protein_name", F.array_join("genes", "; ").alias("genes"), F.when(F.col("reviewed"), "true").otherwise("false").alias("reviewed"), "length")
    out = row.join(known, "accession", "left")
    return out.select(
        *[c for c in row.columns if c not in ("oligomer", "ord")], "ord", text("protein_name").alias("protein_name"), text("genes").alias("genes"),
        text("reviewed").alias("reviewed"), text("length").alias("sequence_length"),
        _pick(F.col("cath_ids"), F.col("scop_ids"), F.col("oligomer")).alias("fold"))


def _normal_ids(listing: DataFrame, columns: Sequence[str], ordinal: str) -> DataFrame:
    """(entry_id, place): ids in upper case without blanks at the ends, each at its first place; null or blank ids go."""
    found = [c for c in columns if c in listing.columns]
    raw = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in found])
    ids = listing.select(F.upper(F.trim(raw)).alias("entry_id"), F.col(ordinal).alias("place"))
    return ids.where(text("entry_id") != "").groupBy("entry_id").agg(F.min("place").alias("place"))


def select_ids(mode: str, explicit: DataFrame | None = None, refresh_plan: DataFrame | None = None, training_set: DataFrame | None = None,
               limit: int | None = None, ordinal: str = "ord") -> DataFrame | None:
    """(entry_id, position) of the entries a job runs over, in the listing's order; None stands for all.

    Explicit ids win over every mode. ``refresh_plan`` takes the plan's ids, ``training_set`` the training listing's (the
    first filled of ``ID_COLUMNS``), ``preview`` the plan's, else the listing's, of which the first ``PREVIEW`` unless
    ``limit`` says otherwise; ``all``, or a listing that isn't there, gives None. A limit of explicit ids counts when it
    isn't 0. Positions start at 0.
    """
    if mode not in ("all", "refresh_plan", "training_set", "preview"):
        raise ValueError(f"unknown selection {mode}")
    if explicit is not None and not explicit.isEmpty():
        chosen, limit = _normal_ids(explicit, ["entry_id"], ordinal), limit or None
    else:
        if mode == "preview" and limit is None:
            limit = PREVIEW
        named, columns = None, ID_COLUMNS
        if mode in ("refresh_plan", "preview") and refresh_plan is not None:
            named, columns = refresh_plan, ["pdb_id"]
        elif mode in ("training_set", "preview"):
            named = training_set
        if named is None:
            return None
        chosen = _normal_ids(named, columns, ordinal)
    if limit is not None:
        chosen = chosen.orderBy("place", "entry_id").limit(limit)
    return with_position(chosen, ["place", "entry_id"], "position").select("entry_id", "position")


def copy_subset(frame: DataFrame, selected: DataFrame | None, key: str) -> DataFrame:
    """The rows of the selected entries, whatever the case of their ids; all rows where nothing was selected."""
    if selected is None:
        return frame
    return frame.join(selected.select(F.col("entry_id").alias("__id")), F.upper(F.trim(key)) == F.col("__id"), "left_semi")
