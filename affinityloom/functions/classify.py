"""Entity classification, interface pairs, role disambiguation and keyword context.

Nested lists belong to one entry, so list logic runs inside the row with higher-order functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinityloom.functions import vocab as V
from affinityloom.functions.text import as_col


def polymer_kind(polymer_type: Column | str, sequence: Column | str) -> Column:
    kind = F.lower(F.coalesce(as_col(polymer_type), F.lit("")))
    protein = kind.isin(V.PROTEIN_POLYMERS)
    short = F.coalesce(F.length(as_col(sequence)) <= V.PEPTIDE_MAX_RESIDUES, F.lit(False))
    return (
        F.when(protein & short, "peptide").when(protein, "protein").when(kind.isin(V.NUCLEIC_POLYMERS), "nucleic_acid")
        .when(kind.isin(V.GLYCAN_POLYMERS), "glycan").otherwise("other_polymer")
    )


def component_kind(component: Column | str) -> Column:
    """Binder type and role of a non-polymer component id."""
    cid = F.upper(F.coalesce(as_col(component), F.lit("")))
    kind = (
        F.when(cid.isin(V.METAL_IONS), "metal_ion").when(cid.isin(V.COFACTORS), "cofactor")
        .when(cid.isin(V.SUGARS), "glycan").when(cid.isin(V.ADDITIVES), "additive").when(cid == "", "unknown")
        .otherwise("small_molecule")
    )
    role = (
        F.when(kind == "metal_ion", "structural_ion").when(kind == "cofactor", "cofactor")
        .when(kind == "additive", "artifact").when(kind == "small_molecule", "primary_ligand").otherwise("unknown")
    )
    return F.struct(kind.alias("binder_type"), role.alias("role"))


def contains_any(value: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | value.contains(w)
    return test


def has_reactive_group(ligand: Column | str) -> Column:
    c = F.coalesce(as_col(ligand), F.lit(""))
    test = F.lit(False)
    for pattern in V.REACTIVE_GROUPS:
        test = test | c.rlike(pattern)
    return test


def membrane_context(*fields: Column | str) -> Column:
    test = F.lit(False)
    for f in fields:
        test = test | contains_any(F.lower(F.coalesce(as_col(f), F.lit(""))), V.MEMBRANE_KEYWORDS)
    return test


def covalent_title(title: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(as_col(title), F.lit(""))), V.COVALENT_TITLES)


def glycan_context(text: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(as_col(text), F.lit(""))), V.GLYCAN_KEYWORDS)


def metal_in_text(text: Column | str) -> Column:
    low = F.lower(F.coalesce(as_col(text), F.lit("")))
    ladder = None
    for word, cid in V.METAL_KEYWORDS:
        ladder = F.when(low.contains(word), cid) if ladder is None else ladder.when(low.contains(word), cid)
    return ladder


def peptide_cofactor_context(description: Column | str, title: Column | str) -> Column:
    d = F.lower(F.coalesce(as_col(description), F.lit("")))
    t = F.lower(F.coalesce(as_col(title), F.lit("")))
    return (
        d.contains("cofactor") | t.contains("cofactor")
        | contains_any(d, ["co-activator", "coactivator", "activator peptide"])
        | (d.contains("ns4a") & (t.contains("ns3/4a") | (t.contains("ns3") & t.contains("protease"))))
    )


def oligomeric_state(protein_chains: Column | str) -> Column:
    """Text from an array (one element per protein entity) of chain-id arrays."""
    c = as_col(protein_chains)
    n = F.coalesce(F.size(c), F.lit(0))
    first = F.coalesce(F.size(F.try_element_at(c, F.lit(1))), F.lit(0))
    second = F.coalesce(F.size(F.try_element_at(c, F.lit(2))), F.lit(0))
    return (
        F.when(n <= 0, "no_protein")
        .when((n == 1) & (first <= 1), "monomer").when((n == 1) & (first == 2), "homodimer")
        .when((n == 1) & (first == 3), "homotrimer").when((n == 1) & (first == 4), "homotetramer")
        .when(n == 1, F.concat(F.lit("homo_"), first.cast("string"), F.lit("mer")))
        .when((n == 2) & (first == 1) & (second == 1), "heterodimer")
        .otherwise(F.concat(F.lit("hetero_complex_"), n.cast("string"), F.lit("_entities")))
    )


def interface_pairs(proteins: Column | str, peptides: Column | str) -> Column:
    """Interfaces of one entry. Elements of both inputs are structs ``(entity, chains)``.

    One protein with several chains gives a symmetric interface of its first chain with the rest;
    several proteins give every unordered pair; the first protein pairs with each peptide.
    """
    p, q = as_col(proteins), as_col(peptides)

    def face(a: Column, ca: Column, b: Column, cb: Column, kind: str, symmetric: bool) -> Column:
        return F.struct(
            a.alias("entity_a"), ca.alias("chains_a"), b.alias("entity_b"), cb.alias("chains_b"),
            F.lit(kind).alias("interface_type"), F.lit(symmetric).alias("is_symmetric"),
            F.lit(not symmetric).alias("is_hetero"),
        )

    homo = F.transform(
        F.filter(p, lambda e: F.size(e["chains"]) >= 2),
        lambda e: face(e["entity"], F.slice(e["chains"], 1, 1), e["entity"],
                       F.slice(e["chains"], 2, F.greatest(F.size(e["chains"]), F.lit(1))), "protein_protein", True),
    )
    hetero = F.flatten(F.transform(
        p, lambda e, i: F.transform(
            F.slice(p, i + 2, F.greatest(F.size(p), F.lit(1))),
            lambda o: face(e["entity"], e["chains"], o["entity"], o["chains"], "protein_protein", False),
        )
    ))
    receptor = F.slice(p, 1, 1)
    peptide = F.flatten(F.transform(
        receptor, lambda e: F.transform(
            q, lambda o: face(e["entity"], e["chains"], o["entity"], o["chains"], "protein_peptide", False)
        )
    ))
    return F.concat(F.when(F.size(p) == 1, homo).otherwise(hetero), peptide)


def disambiguated_roles(objects: Column | str) -> Column:
    """First small molecule stays primary, later ones become co-ligands; a metal on a ligand chain
    becomes a mediated contact. Elements need ``binder_type``, ``role`` and ``chains``."""
    c = as_col(objects)
    small = F.transform(c, lambda o: (o["binder_type"] == "small_molecule").cast("int"))
    first_small = F.array_position(small, 1)
    ligand_chains = F.flatten(F.transform(
        F.filter(c, lambda o: o["binder_type"] == "small_molecule"), lambda o: o["chains"]
    ))
    return F.transform(
        c, lambda o, i: o.withField(
            "role",
            F.when((o["binder_type"] == "small_molecule") & (i + 1 > first_small), "co_ligand")
            .when((o["binder_type"] == "metal_ion") & F.arrays_overlap(o["chains"], ligand_chains),
                  "metal_mediated_contact")
            .otherwise(o["role"]),
        )
    )


def assembly_summary(count: Column, details: Column) -> Column:
    low = F.lower(details)
    return F.struct(
        (count == 1).alias("unit_is_biological"),
        F.when(low.contains("homo"), True).when(low.contains("hetero"), False).alias("is_homo"),
    )


def task_hint(protein_count: Column, nonpolymer_count: Column) -> Column:
    p, n = F.coalesce(protein_count, F.lit(0)), F.coalesce(nonpolymer_count, F.lit(0))
    return F.when((p >= 1) & (n > 0), "protein_ligand").when(p >= 2, "protein_protein").otherwise("unspecified")


def missing_context_objects(objects: Column | str, text: Column | str) -> Column:
    """Append glycans and metals that only the entry text reveals."""
    c = as_col(objects)

    def made(component: Column, kind: str, role: str) -> Column:
        return F.struct(
            component.alias("component"), F.lit(kind).alias("binder_type"), F.lit(role).alias("role"),
            F.array().cast("array<string>").alias("chains"),
        )

    none = F.slice(c, 1, 0)
    glycan = F.when(
        ~F.exists(c, lambda o: o["binder_type"] == "glycan") & glycan_context(text),
        F.array(made(F.lit(None).cast("string"), "glycan", "co_ligand")),
    ).otherwise(none)
    metal = F.when(
        ~F.exists(c, lambda o: o["binder_type"] == "metal_ion") & metal_in_text(text).isNotNull(),
        F.array(made(metal_in_text(text), "metal_ion", "metal_mediated_contact")),
    ).otherwise(none)
    return F.concat(c, glycan, metal)
