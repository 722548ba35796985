"""Quality flags, scores and confidence penalties of one record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinityloom.functions import vocab as V
from affinityloom.functions.text import as_col

LOW_RESOLUTION = 3.5
VERY_LOW_RESOLUTION = 4.5


def named(flags: list[tuple[Column, str]]) -> Column:
    """Ordered array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in flags]))


def scalar_flags(resolution: Column, method: Column, receptor: Column, partner: Column, task: Column,
                 accessions: Column, chains: Column, ligand: Column) -> list[tuple[Column, str]]:
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    return [
        (resolution.isNull(), "no_resolution"),
        (resolution > VERY_LOW_RESOLUTION, "very_low_resolution"),
        ((resolution > LOW_RESOLUTION) & (resolution <= VERY_LOW_RESOLUTION), "low_resolution"),
        (method.isNull(), "no_experimental_method"),
        (receptor.isNull(), "missing_sequence_receptor"),
        ((task == "protein_protein") & partner.isNull(), "missing_sequence_partner"),
        (empty(accessions), "no_uniprot_id"),
        (empty(chains), "no_chain_ids"),
        ((task == "protein_ligand") & ligand.isNull(), "missing_ligand_id"),
    ]


def object_flags(objects: Column, interfaces: Column, polymer_count: Column, assembly_count: Column,
                 membrane: Column) -> list[tuple[Column, str]]:
    """Flags from nested bound objects ``(component, binder_type, role, covalent)`` and interfaces
    ``(is_symmetric, is_hetero)``."""
    real = F.filter(objects, lambda o: F.coalesce(o["role"], F.lit("")) != "artifact")
    free_metal = F.exists(objects, lambda o: (o["binder_type"] == "metal_ion")
                          & ~F.upper(F.coalesce(o["component"], F.lit(""))).isin(V.ALKALI_IONS))
    metal_cofactor = F.exists(objects, lambda o: (o["binder_type"] == "cofactor")
                              & F.coalesce(o["component"], F.lit("")).isin(V.METALLO_COFACTORS))
    return [
        (F.exists(interfaces, lambda i: i["is_symmetric"]), "homomeric_symmetric_interface"),
        (F.exists(interfaces, lambda i: i["is_hetero"]), "heteromeric_interface"),
        ((F.coalesce(polymer_count, F.lit(0)) >= 3) | (F.size(interfaces) >= 2), "multimeric_complex"),
        (F.size(real) > 1, "multiple_bound_objects"),
        (free_metal | metal_cofactor, "metal_present"),
        (free_metal & (F.size(real) > 0), "metal_mediated_binding_possible"),
        (F.exists(objects, lambda o: (o["binder_type"] == "cofactor") | (o["role"] == "cofactor")), "cofactor_present"),
        (F.exists(objects, lambda o: o["binder_type"] == "glycan"), "glycan_present"),
        (F.exists(objects, lambda o: o["covalent"]), "covalent_binder"),
        (F.exists(objects, lambda o: o["binder_type"] == "peptide"), "peptide_partner"),
        (F.exists(objects, lambda o: o["role"] == "artifact"), "possible_crystallization_additive"),
        (assembly_count > 1, "assembly_ambiguity"),
        (membrane, "membrane_protein_context"),
    ]


def share_true(checks: list[Column]) -> Column:
    """Mean of boolean checks, 4 decimals."""
    total = sum([F.coalesce(c, F.lit(False)).cast("int") for c in checks], F.lit(0))
    return F.round(total / F.lit(float(len(checks))), 4)


def sample_score(resolution: Column, method: Column, receptor: Column, partner: Column, task: Column,
                 accessions: Column, chains: Column, taxa: Column, ligand: Column) -> Column:
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return share_true([
        method.isNotNull(), resolution <= LOW_RESOLUTION, receptor.isNotNull(), filled(chains), filled(accessions),
        filled(taxa), (task != "protein_ligand") | ligand.isNotNull(), (task != "protein_protein") | partner.isNotNull(),
    ])


def entry_score(explicit: Column, checks: list[Column]) -> Column:
    """Explicit score clamped to [0,1]; otherwise the share of checks, null when none holds."""
    share = share_true(checks)
    clamped = F.round(F.greatest(F.lit(0.0), F.least(explicit, F.lit(1.0))), 4)
    return F.when(explicit.isNotNull(), clamped).when(share > 0, share)


def confidence_penalty(raw_json: Column | str) -> Column:
    """0.08 per medium and 0.16 per low value of a JSON map; 0.2 when the text is not JSON."""
    raw = F.nullif(as_col(raw_json), F.lit(""))
    parsed = F.try_parse_json(raw)
    levels = F.from_json(raw, "map<string,string>", {"mode": "PERMISSIVE"})
    total = F.aggregate(
        F.map_values(levels), F.lit(0.0),
        lambda s, v: s + F.when(F.lower(v) == "medium", 0.08).when(F.lower(v) == "low", 0.16).otherwise(0.0),
    )
    return F.when(raw.isNull(), 0.0).when(parsed.isNull(), 0.2).otherwise(F.coalesce(total, F.lit(0.0)))
