"""Distances, cells, edge typing, motif and microstate ladders for coordinate tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinityloom.functions.text import as_col, text

# Protein atoms that form a site, by residue and atom name.
SITE_MOTIFS = {
    ("ASP", "OD1"): "asp_carboxylate_oxygen", ("ASP", "OD2"): "asp_carboxylate_oxygen",
    ("GLU", "OE1"): "glu_carboxylate_oxygen", ("GLU", "OE2"): "glu_carboxylate_oxygen",
    ("ASN", "OD1"): "asn_carbonyl_oxygen", ("ASN", "ND2"): "asn_amide_nitrogen",
    ("GLN", "OE1"): "gln_carbonyl_oxygen", ("GLN", "NE2"): "gln_amide_nitrogen",
    ("SER", "OG"): "ser_hydroxyl_oxygen", ("THR", "OG1"): "thr_hydroxyl_oxygen",
    ("TYR", "OH"): "tyr_hydroxyl_oxygen", ("LYS", "NZ"): "lys_terminal_amine_nitrogen",
    ("ARG", "NH1"): "arg_terminal_nitrogen", ("ARG", "NH2"): "arg_terminal_nitrogen",
    ("ARG", "NE"): "arg_central_nitrogen", ("HIS", "ND1"): "his_delta_nitrogen",
    ("HIS", "NE2"): "his_epsilon_nitrogen", ("CYS", "SG"): "cys_sulfur", ("MET", "SD"): "met_sulfur",
    ("TRP", "NE1"): "trp_indole_nitrogen",
}
# Ligand atoms that form a site, by element.
LIGAND_MOTIFS = {
    "O": "carbonyl_oxygen", "N": "amine_nitrogen", "S": "thioether_sulfur", "F": "halogen_atom",
    "CL": "halogen_atom", "BR": "halogen_atom", "I": "halogen_atom",
}
# Residues with a charge and metal elements.
NEGATIVE_RESIDUES = ["ASP", "GLU"]
POSITIVE_RESIDUES = ["ARG", "HIS", "LYS"]
METAL_ELEMENTS = ["CA", "CO", "CU", "FE", "MG", "MN", "NI", "ZN"]
# Default charge of ionisable residues.
RESIDUE_CHARGES = {"ARG": 1.0, "LYS": 1.0, "ASP": -1.0, "GLU": -1.0}


def lookup(c: Column, pairs: dict[str, object]) -> Column:
    ladder = None
    for key, value in pairs.items():
        ladder = F.when(c == key, F.lit(value)) if ladder is None else ladder.when(c == key, F.lit(value))
    return ladder


def distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum([(p - q) * (p - q) for p, q in zip(a[1:], b[1:])], (a[0] - b[0]) * (a[0] - b[0])))


def protein_site_motif(residue: Column | str, atom: Column | str) -> Column:
    r, a = F.upper(text(residue)), F.upper(text(atom))
    ladder = F.when(a == "O", "backbone_carbonyl_oxygen").when(a == "N", "backbone_amide_nitrogen")
    for (rn, an), motif in SITE_MOTIFS.items():
        ladder = ladder.when((r == rn) & (a == an), motif)
    return ladder


def ligand_site_motif(element: Column | str) -> Column:
    return lookup(F.upper(text(element)), LIGAND_MOTIFS)


def charge_proxy(element: Column | str, residue: Column | str) -> Column:
    e, r = as_col(element), as_col(residue)
    return (
        F.when(r.isin(NEGATIVE_RESIDUES) & (e == "O"), -0.5).when(r.isin(POSITIVE_RESIDUES) & (e == "N"), 0.5)
        .when(e.isin(METAL_ELEMENTS), 1.0).otherwise(0.0)
    )


def site_id(entry: Column, chain: Column, residue: Column, number: Column, atom: Column, motif: Column) -> Column:
    return F.concat_ws("|", entry, F.coalesce(F.nullif(chain, F.lit("")), F.lit("-")), residue,
                       number.cast("string"), atom, motif)


def residue_edge_type(charge_a: Column, charge_b: Column, hydro_a: Column, hydro_b: Column, arom_a: Column,
                      arom_b: Column, dist: Column) -> Column:
    return (
        F.when(charge_a * charge_b < 0, "salt_bridge").when(hydro_a & hydro_b, "hydrophobic_contact")
        .when(arom_a & arom_b & (dist <= 6.0), "pi_stacking").otherwise("distance_neighbor")
    )


def atom_edge_type(a: dict[str, Column], b: dict[str, Column], dist: Column) -> Column:
    """Ladder over ``metal``, ``role`` (donor/acceptor), ``charge``, ``aromatic`` and ``radius``."""
    donor_acceptor = ((a["role"] == "donor") & (b["role"] == "acceptor")) | (
        (b["role"] == "donor") & (a["role"] == "acceptor"))
    return (
        F.when(dist <= 1.9, "covalent_bond").when(a["metal"] | b["metal"], "metal_coordination")
        .when(donor_acceptor & (dist <= 3.5), "hydrogen_bond")
        .when((a["charge"] * b["charge"] < 0) & (dist <= 4.5), "salt_bridge")
        .when(a["aromatic"] & b["aromatic"] & (dist <= 5.5), "pi_stacking")
        .when(dist <= F.least(a["radius"] + b["radius"], F.lit(5.0)), "hydrophobic_contact")
        .otherwise("distance_neighbor")
    )


EDGE_TYPE_ORDER = ["covalent_bond", "hydrogen_bond", "salt_bridge", "hydrophobic_contact", "pi_stacking",
                   "metal_coordination"]


def edge_vector(edge_type: Column, dist: Column) -> Column:
    return F.array(F.coalesce(dist, F.lit(0.0)),
                   *[F.when(edge_type == t, 1.0).otherwise(0.0) for t in EDGE_TYPE_ORDER])


def microstate(residue: Column, same: Column, opposite: Column, metal: Column) -> Column:
    """Adjusted charge, state label and confidence of one ionisable residue."""
    base = F.coalesce(lookup(residue, RESIDUE_CHARGES), F.lit(0.0))

    def near(c: Column, limit: float) -> Column:
        return F.coalesce(c < limit, F.lit(False))

    def step(test: Column, amount: float) -> Column:
        return F.when(test, amount).otherwise(0.0)

    acid = F.greatest(F.lit(-1.0), F.least(
        F.lit(0.0), base + step(near(same, 4.0), 0.35) - step(near(opposite, 4.5), 0.20) - step(near(metal, 3.2), 0.25)))
    basic = F.greatest(F.lit(0.0), F.least(
        F.lit(1.0), base - step(near(same, 4.0), 0.25) + step(near(opposite, 4.5), 0.10)))
    his = (F.when(near(metal, 3.2), 0.7).when(near(opposite, 4.0), 0.5).when(near(same, 4.0), 0.1).otherwise(base))
    soft = F.when(near(metal, 3.0), -0.4).when(near(opposite, 4.0), -0.2).otherwise(0.0)
    is_acid, is_basic = residue.isin("ASP", "GLU"), residue.isin("LYS", "ARG")
    is_his, is_soft = residue == "HIS", residue.isin("CYS", "TYR")
    charge = F.when(is_acid, acid).when(is_basic, basic).when(is_his, his).when(is_soft, soft).otherwise(base)
    state = (
        F.when(is_acid, F.when(acid <= -0.65, "deprotonated").otherwise("possibly_protonated"))
        .when(is_basic, F.when(basic >= 0.6, "protonated").otherwise("possibly_neutralized"))
        .when(is_his, F.when(his >= 0.6, "protonated").when(his >= 0.25, "mixed").otherwise("neutral"))
        .when(is_soft, F.when(soft <= -0.3, "deprotonated_like").otherwise("neutral")).otherwise("unknown")
    )
    seen = same.isNotNull() | opposite.isNotNull()
    confident = ((is_acid | is_his) & (seen | metal.isNotNull())) | (is_basic & seen)
    return F.struct(
        base.alias("canonical_charge"), F.round(charge, 4).alias("adjusted_charge"), state.alias("state"),
        F.when(confident, "medium").otherwise("low").alias("confidence"),
    )


def descriptor_distance(a: Column | str, b: Column | str) -> Column:
    """Mean of |l-r| / max(|l|,|r|,1); 1.0 when the vectors are empty or differ in length."""
    x, y = as_col(a), as_col(b)
    terms = F.zip_with(x, y, lambda p, q: F.abs(p - q) / F.greatest(F.abs(p), F.abs(q), F.lit(1.0)))
    total = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    return F.when((F.size(x) > 0) & (F.size(x) == F.size(y)), total / F.size(x)).otherwise(F.lit(1.0))


def context_alignment(query: Column | str, profile: Column | str) -> Column:
    """Mean over shared keys of max(0, 1-|q-p|/max(|q|,|p|,1)), 4 decimals; 0 without shared keys."""
    q, p = as_col(query), as_col(profile)
    shared = F.filter(
        F.map_values(F.map_zip_with(
            q, p, lambda k, a, b: F.greatest(F.lit(0.0), 1.0 - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0)))
            * F.when(a.isNotNull() & b.isNotNull(), 1.0))),
        lambda v: v.isNotNull(),
    )
    return F.coalesce(
        F.round(F.try_divide(F.aggregate(shared, F.lit(0.0), lambda s, v: s + v), F.size(shared)), 4), F.lit(0.0)
    )
