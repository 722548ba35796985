"""Distance joins on coordinate tables through a cell grid, and what is aggregated from them.

Points are joined on (structure, cell) with cells as wide as the radius, so work follows the number
of neighbours instead of the square of a structure. Cell keys spread one large structure over many
tasks; a dense cell is left to the skew-join splitting of adaptive execution.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.functions import structure as S
from affinityloom.functions.vocab import HYDROPATHY, SHELLS
from affinityloom.operators.ordering import consecutive_pairs, with_group_rank

XYZ = ("x", "y", "z")
OFFSETS = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
FORWARD = [o for o in OFFSETS if o >= (0, 0, 0)]


def _cells(radius: float) -> list[Column]:
    if radius <= 0:
        raise ValueError("radius must be positive")
    return [F.floor(F.col(c) / F.lit(radius)).cast("bigint").alias(f"_c{c}") for c in XYZ]


def _spread(df: DataFrame, offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    """Copies of each row for the neighbour cells, tagged with whether the cell is its own."""
    steps = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("i", "j", "k"), o)]) for o in offsets])
    return df.withColumn("_o", F.explode(steps)).select(
        *[c for c in df.columns if c not in ("_cx", "_cy", "_cz")],
        *[(F.col(f"_c{c}") + F.col(f"_o.{n}")).alias(f"_c{c}") for c, n in zip(XYZ, ("i", "j", "k"))],
        ((F.col("_o.i") == 0) & (F.col("_o.j") == 0) & (F.col("_o.k") == 0)).alias("_home"))


def near_pairs(points: DataFrame, structure: str, point: str, radius: float, payload: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of one structure within ``radius``: ``<c>_a``, ``<c>_b`` (smaller id first), distance.

    Only the 14 forward cells are visited, so each pair of cells meets once.
    """
    cols = list(dict.fromkeys([point, *XYZ, *payload]))
    base = points.select(structure, *cols, *_cells(radius))
    left = _spread(base, FORWARD).select(structure, "_cx", "_cy", "_cz", "_home", F.struct(*cols).alias("p"))
    right = base.select(structure, "_cx", "_cy", "_cz", F.struct(*cols).alias("q"))
    met = left.join(right, [structure, "_cx", "_cy", "_cz"]).filter(
        ~F.col("_home") | (F.col(f"p.{point}") < F.col(f"q.{point}")))
    dist = S.distance(tuple(F.col(f"p.{c}") for c in XYZ), tuple(F.col(f"q.{c}") for c in XYZ))
    first = F.col(f"p.{point}") < F.col(f"q.{point}")
    a, b = F.when(first, F.col("p")).otherwise(F.col("q")), F.when(first, F.col("q")).otherwise(F.col("p"))
    return met.withColumn("distance", dist).filter(F.col("distance") <= radius).select(
        structure, a.alias("a"), b.alias("b"), "distance").select(
        structure, *[F.col(f"a.{c}").alias(f"{c}_a") for c in cols if c not in XYZ],
        *[F.col(f"b.{c}").alias(f"{c}_b") for c in cols if c not in XYZ], "distance")


def near_join(centers: DataFrame, points: DataFrame, structure: str, radius: float, center_cols: Sequence[str],
              point_cols: Sequence[str]) -> DataFrame:
    """Centers with every point of the same structure within ``radius``; columns of both and distance.

    The centers, the smaller side, are copied to their 27 cells.
    """
    c = _spread(centers.select(structure, F.struct(*XYZ).alias("_p"), *center_cols, *_cells(radius)), OFFSETS).drop("_home")
    q = points.select(structure, F.struct(*XYZ).alias("_q"), *point_cols, *_cells(radius))
    dist = S.distance(tuple(F.col(f"_p.{v}") for v in XYZ), tuple(F.col(f"_q.{v}") for v in XYZ))
    return c.join(q, [structure, "_cx", "_cy", "_cz"]).withColumn("distance", dist).filter(
        F.col("distance") <= radius).select(structure, *center_cols, *point_cols, "distance")


def both_ends(pairs: DataFrame, point: str, payload: Sequence[str] = ()) -> DataFrame:
    """Each pair seen from both ends: (point, other, other's payload, distance)."""
    ends = [
        F.struct(F.col(f"{point}_{m}").alias(point), F.col(f"{point}_{o}").alias("other"), F.col("distance"),
                 *[F.col(f"{p}_{m}").alias(p) for p in payload], *[F.col(f"{p}_{o}").alias(f"other_{p}") for p in payload])
        for m, o in (("a", "b"), ("b", "a"))
    ]
    keep = [c for c in pairs.columns if not c.endswith(("_a", "_b")) and c != "distance"]
    return pairs.select(*keep, F.inline(F.array(*ends)))


#: Distances that a task holds at once.
DISTANCES_AT_ONCE = 1 << 16


def shell_descriptors(sites: DataFrame, atoms: DataFrame, structure: str, site: str, atom_flags: Sequence[str],
                      charge: str, shells: Sequence[tuple[str, float, float]] = tuple(SHELLS)) -> DataFrame:
    """Counts and charge sums per (site, shell); empty shells give zero rows.

    Both shell ends are inclusive, so an atom on a boundary counts in two shells; distance 0 is the
    site itself and is skipped. ``site`` is unique within a structure.

    Atoms are copied to the 27 cells around their own where there are sites, so a cell's sites see all their atoms in one
    task and are done with. Time grows with the pairs of a site and its atoms, which are never made as rows; memory grows
    with the atoms of 27 cells.
    """
    reach = max(end for _, _, end in shells)
    cell = ["_structure", "_cx", "_cy", "_cz"]
    own = sites.select(F.col(structure).alias("_structure"), F.col(site), *[F.col(c).cast("double").alias(c) for c in XYZ], *_cells(reach))
    taken = own.select(*cell).distinct()
    near = _spread(atoms.select(
        F.col(structure).alias("_structure"), *[F.col(c).cast("double").alias(c) for c in XYZ], F.col(charge).cast("double").alias("_q"),
        *[F.coalesce(F.col(f).cast("boolean"), F.lit(False)).alias(f"_f{i}") for i, f in enumerate(atom_flags)], *_cells(reach)),
        OFFSETS).drop("_home").join(taken, cell, "left_semi")
    sums = ["charge_sum", "positive_sum", "negative_sum", "inverse_sum", "inverse_square_sum"]
    counts = ["neighbor_count", *[f"{f}_count" for f in atom_flags]]
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    fields = ", ".join([f"`{structure}` {kind(sites, structure)}", f"`{site}` {kind(sites, site)}", "shell string",
                        *[f"`{c}` bigint" for c in counts], "nearest double", *[f"{c} double" for c in sums]])
    names = [structure, site, "shell", *counts, "nearest", *sums]

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        number = lambda t, c: t.column(c).cast(pa.float64()).fill_null(np.nan).to_numpy()
        if mine.num_rows and mine.column("_structure")[0].as_py() is None:
            others = others.slice(0, 0)
        s, a = (np.stack([number(t, c) for c in XYZ]) for t in (mine, others))
        q = np.nan_to_num(number(others, "_q"))
        flags = [others.column(f"_f{i}").to_numpy().astype(np.float64) for i in range(len(atom_flags))]
        facts = np.stack([np.ones(len(q)), *flags, q, np.maximum(q, 0), np.minimum(q, 0)], 1)
        step = max(DISTANCES_AT_ONCE // max(len(q), 1), 1)
        found = np.zeros((mine.num_rows, len(shells), facts.shape[1] + 2))
        least = np.full((mine.num_rows, len(shells)), np.inf)
        for at in range(0, mine.num_rows if len(q) else 0, step):
            rows = slice(at, at + step)
            square = (s[0, rows, None] - a[0]) ** 2
            for k in (1, 2):
                square += (s[k, rows, None] - a[k]) ** 2
            d = np.sqrt(square)
            inverse, inverse_square = 1 / np.fmax(d, 0.1), 1 / np.fmax(d * d, 0.1)
            for k, (_, low, high) in enumerate(shells):
                inside = (d >= low) & (d <= high) & (d > 0)
                weight = inside.astype(np.float64)
                found[rows, k, :-2] = weight @ facts
                found[rows, k, -2] = (weight * inverse) @ q
                found[rows, k, -1] = (weight * inverse_square) @ q
                least[rows, k] = np.where(inside, d, np.inf).min(1)
        whole = 1 + len(flags)
        out = []
        for k, (name, _, _) in enumerate(shells):
            out.append(pa.Table.from_arrays([
                mine.column("_structure"), mine.column(site), pa.array([name] * mine.num_rows, pa.string()),
                *[pa.array(np.rint(found[:, k, i]).astype(np.int64)) for i in range(whole)],
                pa.array(least[:, k], mask=np.isinf(least[:, k])),
                *[pa.array(found[:, k, i]) for i in range(whole, whole + len(sums))]], names))
        return pa.concat_tables(out)

    stats = own.groupBy(*cell).cogroup(near.groupBy(*cell)).applyInArrow(run, fields)
    return stats.select(
        structure, site, "shell", *counts, "nearest", *[F.round(c, 6).alias(c) for c in sums],
        F.round(F.abs("charge_sum"), 6).alias("field_magnitude"))


def refined_sites(shells: DataFrame, structure: str, site: str) -> DataFrame:
    """Per-site proxies over its shells, with a hash of the rounded environment."""
    n = F.count(F.lit(1))
    charge = F.sum("charge_sum")
    donors, acceptors = F.sum("donor_count"), F.sum("acceptor_count")
    metals, rings = F.sum("metal_count"), F.sum("aromatic_count")
    env = F.sort_array(F.collect_list(F.struct("shell", "neighbor_count", "charge_sum", "donor_count", "acceptor_count")))
    return shells.groupBy(structure, site).agg(
        F.round(charge / n, 6).alias("refined_charge"), F.round(charge, 6).alias("potential"),
        F.round(F.max("field_magnitude"), 6).alias("field"), F.round(donors / n, 6).alias("donor_strength"),
        F.round(acceptors / n, 6).alias("acceptor_strength"),
        F.round((donors + acceptors + rings) / n, 6).alias("polarizability"),
        F.round(F.max("neighbor_count") / 10.0, 6).alias("steric_radius"),
        F.round(F.greatest(F.lit(0.0), -charge), 6).alias("desolvation"),
        F.round(F.least(F.lit(1.0), metals / n), 6).alias("metal_propensity"),
        F.round(F.least(F.lit(1.0), rings / n), 6).alias("aromatic_propensity"),
        F.round(F.greatest(F.lit(0.0), n - donors - acceptors) / n, 6).alias("strain"),
        F.sha2(F.to_json(env), 256).alias("environment_hash"))


def site_edges(sites: DataFrame, structure: str, site: str, radius: float = 8.0) -> DataFrame:
    pairs = near_pairs(sites, structure, site, radius)
    return pairs.withColumn("distance", F.round("distance", 6))


def enriched_edges(edges: DataFrame, refined: DataFrame, structure: str, site: str) -> DataFrame:
    """Edge scores from both ends' refined charge and motif (missing ends count as neutral)."""
    def end(tag: str) -> DataFrame:
        return refined.select(structure, F.col(site).alias(f"{site}_{tag}"), F.col("refined_charge").alias(f"q_{tag}"),
                              F.col("motif").alias(f"m_{tag}"))

    e = edges.join(end("a"), [structure, f"{site}_a"], "left").join(end("b"), [structure, f"{site}_b"], "left")
    return _scored(e, edges.columns)


def enriched_site_edges(sites: DataFrame, refined: DataFrame, structure: str, site: str, radius: float = 8.0) -> DataFrame:
    """``enriched_edges`` of ``site_edges``: sites bring their charge and motif, so no edge is moved to look them up."""
    own = refined.select(structure, site, F.col("refined_charge").alias("q"), F.col("motif").alias("m"))
    known = sites.select(structure, site, *XYZ).join(own, [structure, site], "left")
    edges = near_pairs(known, structure, site, radius, ["q", "m"]).withColumn("distance", F.round("distance", 6))
    return _scored(edges, [structure, f"{site}_a", f"{site}_b", "distance"])


def _scored(e: DataFrame, kept: Sequence[str]) -> DataFrame:
    d = F.col("distance")
    qq = F.coalesce("q_a", F.lit(0.0)) * F.coalesce("q_b", F.lit(0.0))
    ring = F.coalesce("m_a", F.lit("")).contains("aromatic_centroid") & F.coalesce("m_b", F.lit("")).contains("aromatic_centroid")
    metal = (F.coalesce("m_a", F.lit("")) == "metal_ion") | (F.coalesce("m_b", F.lit("")) == "metal_ion")
    return e.select(
        *kept, F.round(qq / F.greatest(d, F.lit(0.1)), 6).alias("coulombic"),
        F.round(F.greatest(F.lit(0.0), 1.0 - F.abs(d - 3.0) / 3.0), 6).alias("hbond_geometry"),
        F.when((qq < 0) & (d < 4.5), 1.0).otherwise(0.0).alias("salt_bridge"),
        F.round(F.greatest(F.lit(0.0), 1.0 - d / 8.0), 6).alias("overlap"),
        F.when(d < 2.0, 1.0).otherwise(0.0).alias("clash"), F.when(ring & (d < 5.0), 1.0).otherwise(0.0).alias("stacking"),
        metal.alias("metal_bridge"))


def nearest_charges(residues: DataFrame, metals: DataFrame, structure: str, residue: str, sign: str,
                    charge_radius: float = 6.0, metal_radius: float = 5.0) -> DataFrame:
    """Nearest same-sign and opposite-sign residue and nearest metal per structure and residue (null when none)."""
    ends = both_ends(near_pairs(residues.filter(F.col(sign) != 0), structure, residue, charge_radius, [sign]), residue, [sign])
    alike = F.col(sign) * F.col(f"other_{sign}") > 0
    near = ends.groupBy(structure, residue).agg(F.min(F.when(alike, F.col("distance"))).alias("same"),
                                     F.min(F.when(~alike, F.col("distance"))).alias("opposite"))
    metal = near_join(residues, metals, structure, metal_radius, [residue], []).groupBy(structure, residue).agg(
        F.min("distance").alias("metal"))
    return residues.join(near, [structure, residue], "left").join(metal, [structure, residue], "left")


def within_radius(points: DataFrame, focus: DataFrame, structure: str, point: str, radius: float) -> DataFrame:
    """Points within ``radius`` of any focus point of the same structure."""
    hits = near_join(focus, points, structure, radius, [], [point]).select(structure, point).distinct()
    return points.join(hits, [structure, point], "left_semi")


def scope_points(points: DataFrame, structure: str, point: str, scope: str, focus: DataFrame | None = None,
                 chains: DataFrame | None = None, radius: float = 8.0) -> DataFrame:
    """Whole structure, interface only (focus points, else scoped chains), or shell around focus points."""
    if scope == "whole_protein":
        return points
    if scope == "shell":
        return within_radius(points, focus, structure, point, radius)
    if scope != "interface_only":
        raise ValueError(f"unknown scope {scope}")
    with_focus = focus.select(structure).distinct()
    named = points.join(focus.select(structure, point).distinct(), [structure, point], "left_semi")
    by_chain = points.join(with_focus, structure, "left_anti").join(chains, [structure, "chain"], "left_semi")
    return named.unionByName(by_chain)


def fragments(sites: DataFrame, atoms: DataFrame, structure: str, site: str, atom: str, radius: float = 6.0) -> DataFrame:
    """Heavy atoms around representative sites, one row each with rounded distance."""
    return near_join(sites, atoms.filter("is_heavy"), structure, radius, [site], [atom]).withColumn(
        "distance", F.round("distance", 6))


def structure_descriptors(atoms: DataFrame, structure: str, residue: str) -> DataFrame:
    """Atom counts and means, residue count and radius of gyration of residue centroids.

    The radius is the root of the summed population variances of the centroid coordinates: one pass.
    """
    per_residue = atoms.groupBy(structure, residue).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("is_heavy").cast("int")).alias("_heavy"),
        F.sum("b_factor").alias("_b"), F.sum("occupancy").alias("_o"), *[F.avg(c).alias(c) for c in XYZ])
    return per_residue.groupBy(structure).agg(
        F.sum("_n").alias("atom_count"), F.round(F.sum("_heavy") / F.sum("_n"), 6).alias("heavy_fraction"),
        F.round(F.sum("_b") / F.sum("_n"), 6).alias("mean_b_factor"),
        F.round(F.sum("_o") / F.sum("_n"), 6).alias("mean_occupancy"), F.count(F.lit(1)).alias("residue_count"),
        F.round(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")), 6).alias("radius_of_gyration"))


def sequence_composition(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Length, mean hydropathy and aromatic/charged/polar fractions over the recognised residues."""
    s = F.coalesce(F.col(sequence), F.lit(""))
    count = lambda letters: F.length(F.regexp_replace(s, f"[^{letters}]", ""))
    each = {r: (F.length(s) - F.length(F.replace(s, F.lit(r), F.lit("")))) for r in HYDROPATHY}
    known = sum(each.values(), F.lit(0))
    # Tenths keep the weighted sum an exact integer.
    tenths = sum([c * int(round(HYDROPATHY[r] * 10)) for r, c in each.items()], F.lit(0))
    rows = df.select(key, F.length(s).alias("length"), known.alias("_known"), tenths.alias("_tenths"),
                     count("FWYH").alias("_aromatic"), count("DEKRH").alias("_charged"), count("NQSTYCHDEKR").alias("_polar"))
    over = lambda c: F.round(F.try_divide(F.col(c), F.col("_known")), 6)
    return rows.select(key, "length", F.round(F.try_divide(F.col("_tenths") / 10.0, F.col("_known")), 6).alias("mean_hydropathy"),
                       over("_aromatic").alias("aromatic_fraction"), over("_charged").alias("charged_fraction"),
                       over("_polar").alias("polar_fraction"))


def physics_summary(microstates: DataFrame, key: str) -> DataFrame:
    """Charge and contact summary per key over assigned microstates."""
    q = F.coalesce("charge", F.lit(0.0))
    near = lambda c, limit: F.count_if(F.col(c) < limit)
    penalty = F.coalesce(F.sum(F.when(F.col("residue").isin("ASP", "GLU") & (F.col("same") < 4.0),
                                      1.0 / F.greatest(F.col("same"), F.lit(0.1)))), F.lit(0.0))
    return microstates.groupBy(key).agg(
        F.count(F.lit(1)).alias("record_count"), F.round(F.sum(q), 4).alias("net_charge"),
        F.round(F.avg(F.abs(q)), 4).alias("mean_abs_charge"), F.count_if(q > 0.2).alias("positive_count"),
        F.count_if(q < -0.2).alias("negative_count"), near("same", 4.5).alias("same_contacts"),
        near("opposite", 4.5).alias("opposite_contacts"), near("metal", 3.2).alias("metal_contacts"),
        F.round(penalty, 4).alias("acidic_penalty"),
        F.round(near("opposite", 4.5) - near("same", 4.5) - penalty, 4).alias("balance"))


def site_feature_pivot(shells: DataFrame, edges: DataFrame, structure: str, site: str, measures: Sequence[str],
                       shell_names: Sequence[str]) -> DataFrame:
    """Shell measures as wide columns plus neighbour count and min/mean/max edge distance per site."""
    wide = shells.groupBy(structure, site).agg(*[
        F.coalesce(F.max(F.when(F.col("shell") == s, F.col(m))), F.lit(0)).cast("double").alias(f"{s}_{m}")
        for s in shell_names for m in measures])
    ends = edges.select(structure, F.explode(F.array(f"{site}_a", f"{site}_b")).alias(site), "distance")
    stats = ends.groupBy(structure, site).agg(
        F.count(F.lit(1)).cast("double").alias("neighbor_sites"), F.min("distance").alias("min_distance"),
        F.round(F.avg("distance"), 6).alias("mean_distance"), F.max("distance").alias("max_distance"))
    return wide.join(stats, [structure, site], "left").na.fill(0.0)


def residue_edges(nodes: DataFrame, structure: str, node: str, number: str, radius: float = 8.0) -> DataFrame:
    """Chain-consecutive covalent edges plus typed contacts within the radius."""
    chain = consecutive_pairs(nodes.select(structure, "chain", number, node, *XYZ), [structure, "chain"], [number, node],
                              [node, *XYZ])
    bonds = chain.select(
        structure, f"{node}_a", f"{node}_b", F.lit("covalent_bond").alias("edge_type"),
        S.distance(tuple(F.col(f"{c}_a") for c in XYZ), tuple(F.col(f"{c}_b") for c in XYZ)).alias("distance"))
    traits = ["charge", "hydrophobic", "aromatic"]
    pairs = near_pairs(nodes, structure, node, radius, traits)
    kind = S.residue_edge_type(F.col("charge_a"), F.col("charge_b"), F.col("hydrophobic_a"), F.col("hydrophobic_b"),
                               F.col("aromatic_a"), F.col("aromatic_b"), F.col("distance"))
    contacts = pairs.select(structure, f"{node}_a", f"{node}_b", kind.alias("edge_type"), "distance")
    return bonds.unionByName(contacts)


def atom_edges(nodes: DataFrame, structure: str, node: str, radius: float) -> DataFrame:
    traits = ["metal", "role", "charge", "aromatic", "radius"]
    pairs = near_pairs(nodes, structure, node, radius, traits)
    side = lambda t: {k: F.col(f"{k}_{t}") for k in traits}
    return pairs.select(structure, f"{node}_a", f"{node}_b",
                        S.atom_edge_type(side("a"), side("b"), F.col("distance")).alias("edge_type"), "distance")


EDGE_COUNTS = ["covalent_bond", "hydrogen_bond", "salt_bridge", "hydrophobic_contact", "pi_stacking",
               "metal_coordination", "distance_neighbor"]


def graph_summary(nodes: DataFrame, edges: DataFrame, structure: str) -> DataFrame:
    """Node, helix/sheet/coil and per-type edge counts per structure."""
    ss = F.coalesce("secondary", F.lit(""))
    n = nodes.groupBy(structure).agg(
        F.count(F.lit(1)).alias("node_count"), F.count_if(ss == "helix").alias("helix_count"),
        F.count_if(ss == "sheet").alias("sheet_count"), F.count_if(~ss.isin("helix", "sheet")).alias("coil_count"))
    e = edges.groupBy(structure).agg(
        F.count(F.lit(1)).alias("edge_count"), *[F.count_if(F.col("edge_type") == t).alias(f"{t}_count") for t in EDGE_COUNTS])
    return n.join(e, structure, "left").na.fill(0)


def indexed_edges(nodes: DataFrame, edges: DataFrame, structure: str, node: str, ordinal: str) -> DataFrame:
    """Edges as node positions inside their structure, both directions; unknown ends drop out."""
    place = with_group_rank(nodes.select(structure, node, ordinal), [structure], [F.col(ordinal)], "_i").select(
        structure, node, (F.col("_i") - 1).alias("_i"))

    def end(tag: str) -> DataFrame:
        return place.select(structure, F.col(node).alias(f"{node}_{tag}"), F.col("_i").alias(f"i_{tag}"))

    known = edges.join(end("a"), [structure, f"{node}_a"]).join(end("b"), [structure, f"{node}_b"])
    return known.select(structure, F.inline(F.array(
        F.struct(F.col("i_a").alias("source_index"), F.col("i_b").alias("target_index"), "edge_type"),
        F.struct(F.col("i_b").alias("source_index"), F.col("i_a").alias("target_index"), "edge_type"))))
