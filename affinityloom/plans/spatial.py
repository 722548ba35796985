"""Spatial queries: the first three embedding dimensions as coordinates, the label as structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.functions import structure as S
from affinityloom.operators import spatial as P
from affinityloom.plans.registry import query, table
from affinityloom.plans.scalars import RESIDUE_CYCLE, pick, sql_pick

ELEMENTS = ["C", "N", "O", "ZN", "H"]
PTS_SQL = f"""pts AS (SELECT vec_id, label AS structure, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS z,
  {sql_pick(ELEMENTS, 'vec_id')} AS element, {sql_pick(RESIDUE_CYCLE, 'vec_id // 3')} AS residue, (['A', 'B'])[CAST(vec_id % 2 AS INT) + 1] AS chain,
  CASE WHEN vec_id % 5 = 1 THEN 0.5 WHEN vec_id % 5 = 2 THEN -0.5 WHEN vec_id % 5 = 3 THEN 1.0 ELSE 0.0 END::DOUBLE AS charge FROM embeddings),
prs AS (SELECT a.structure, a.vec_id AS vec_id_a, b.vec_id AS vec_id_b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS distance
  FROM pts a JOIN pts b ON a.structure = b.structure AND a.vec_id < b.vec_id),
dir AS (SELECT structure, vec_id_a AS p, vec_id_b AS q, distance FROM prs UNION ALL SELECT structure, vec_id_b, vec_id_a, distance FROM prs)"""


def points(spark, sf_dir):
    n = F.col("vec_id")
    at = lambda i: F.col("embedding")[i].cast("double") * 20
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("structure"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"),
        pick(ELEMENTS, n).alias("element"), pick(RESIDUE_CYCLE, F.floor(n / 3)).alias("residue"), pick(["A", "B"], n).alias("chain"),
        F.when(n % 5 == 1, 0.5).when(n % 5 == 2, -0.5).when(n % 5 == 3, 1.0).otherwise(0.0).alias("charge"),
        (n % 5 != 4).alias("is_heavy"), (F.lit(20.0) + n % 17).alias("b_factor"), F.lit(1.0).alias("occupancy"))


@query("near_pairs", "C13", f"WITH {PTS_SQL} SELECT structure, vec_id_a, vec_id_b, round(distance, 6) AS distance FROM prs WHERE distance <= 2.5")
def near_pairs(spark, sf_dir):
    return P.near_pairs(points(spark, sf_dir), "structure", "vec_id", 2.5).withColumn("distance", F.round("distance", 6))


@query("site_pair_edges", "C15", f"WITH {PTS_SQL} SELECT p.structure, vec_id_a, vec_id_b, round(distance, 6) AS distance FROM prs p WHERE distance <= 8.0 AND vec_id_a % 5 IN (1, 2) AND vec_id_b % 5 IN (1, 2)")
def site_pair_edges(spark, sf_dir):
    return P.site_edges(points(spark, sf_dir).filter("element IN ('N', 'O')"), "structure", "vec_id")


SHELL_SQL = f"""WITH {PTS_SQL}, band AS (SELECT * FROM (VALUES ('shell_1', 0.0, 3.5), ('shell_2', 3.5, 6.0), ('shell_3', 6.0, 8.0)) v(shell, lo, hi)),
sites AS (SELECT structure, vec_id FROM pts WHERE element IN ('N', 'O')),
hit AS (SELECT d.structure, d.p AS vec_id, b.shell, d.distance, t.element, t.charge, t.residue FROM dir d JOIN sites s ON s.vec_id = d.p JOIN band b ON d.distance BETWEEN b.lo AND b.hi JOIN pts t ON t.vec_id = d.q WHERE d.distance > 0),
sh AS (SELECT s.structure, s.vec_id, b.shell, count(h.distance) AS neighbor_count, count(*) FILTER (h.element = 'N') AS donor_count, count(*) FILTER (h.element = 'O') AS acceptor_count,
  count(*) FILTER (h.element = 'ZN') AS metal_count, count(*) FILTER (h.residue IN ('HIS', 'TYR')) AS aromatic_count, min(h.distance) AS nearest,
  round(coalesce(sum(h.charge), 0), 6) AS charge_sum, round(coalesce(sum(h.charge) FILTER (h.charge > 0), 0), 6) AS positive_sum, round(coalesce(sum(h.charge) FILTER (h.charge < 0), 0), 6) AS negative_sum,
  round(coalesce(sum(h.charge / greatest(h.distance, 0.1)), 0), 6) AS inverse_sum, round(abs(coalesce(sum(h.charge), 0)), 6) AS field_magnitude
  FROM sites s CROSS JOIN band b LEFT JOIN hit h ON h.vec_id = s.vec_id AND h.shell = b.shell GROUP BY ALL)"""


def sites_and_shells(spark, sf_dir):
    p = points(spark, sf_dir)
    atoms = p.withColumn("donor", F.col("element") == "N").withColumn("acceptor", F.col("element") == "O").withColumn(
        "metal", F.col("element") == "ZN").withColumn("aromatic", F.col("residue").isin("HIS", "TYR"))
    sites = p.filter("element IN ('N', 'O')")
    return sites, P.shell_descriptors(sites, atoms, "structure", "vec_id", ["donor", "acceptor", "metal", "aromatic"], "charge")


@query("shell_descriptors", "C14 D18",
       SHELL_SQL + " SELECT structure, vec_id, shell, neighbor_count, donor_count, acceptor_count, metal_count, aromatic_count, round(nearest, 6) AS nearest, charge_sum, positive_sum, negative_sum, inverse_sum, field_magnitude FROM sh")
def shell_descriptors(spark, sf_dir):
    return sites_and_shells(spark, sf_dir)[1].withColumn("nearest", F.round("nearest", 6)).drop("inverse_square_sum")


REFINED_SQL = """, rf AS (SELECT structure, vec_id, round(sum(charge_sum) / 3, 6) AS refined_charge, round(sum(charge_sum), 6) AS potential, max(field_magnitude) AS field,
  round(sum(donor_count) / 3.0::DOUBLE, 6) AS donor_strength, round(max(neighbor_count) / 10.0::DOUBLE, 6) AS steric_radius, round(least(1.0, sum(metal_count) / 3.0::DOUBLE), 6) AS metal_propensity,
  round(greatest(0.0, 3 - sum(donor_count) - sum(acceptor_count)) / 3.0::DOUBLE, 6) AS strain FROM sh GROUP BY 1, 2)"""


@query("refined_sites", "D19", SHELL_SQL + REFINED_SQL + " SELECT * FROM rf")
def refined_sites(spark, sf_dir):
    return P.refined_sites(sites_and_shells(spark, sf_dir)[1], "structure", "vec_id").select(
        "structure", "vec_id", "refined_charge", "potential", "field", "donor_strength", "steric_radius", "metal_propensity", "strain")


@query("enriched_site_edges", "C20",
       SHELL_SQL + REFINED_SQL + """, e AS (SELECT structure, vec_id_a, vec_id_b, round(distance, 6) AS distance FROM prs WHERE distance <= 8.0 AND vec_id_a % 5 IN (1, 2) AND vec_id_b % 5 IN (1, 2))
       SELECT e.vec_id_a, e.vec_id_b, round(a.refined_charge * b.refined_charge / greatest(distance, 0.1), 6) + 0.0::DOUBLE AS coulombic, round(greatest(0.0, 1 - abs(distance - 3) / 3), 6) AS hbond_geometry,
         CASE WHEN a.refined_charge * b.refined_charge < 0 AND distance < 4.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS salt_bridge, CASE WHEN distance < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS clash FROM e JOIN rf a ON a.vec_id = vec_id_a JOIN rf b ON b.vec_id = vec_id_b""")
def enriched_site_edges(spark, sf_dir):
    sites, shells = sites_and_shells(spark, sf_dir)
    refined = P.refined_sites(shells, "structure", "vec_id").join(
        sites.select("structure", "vec_id", F.lower("element").alias("motif")), ["structure", "vec_id"])
    return P.enriched_site_edges(sites, refined, "structure", "vec_id").select(
        "vec_id_a", "vec_id_b", "coulombic", "hbond_geometry", "salt_bridge", "clash")


@query("site_feature_pivot", "D20",
       SHELL_SQL + """, e AS (SELECT vec_id_a AS v, distance AS d FROM prs WHERE distance <= 8.0 AND vec_id_a % 5 IN (1, 2) AND vec_id_b % 5 IN (1, 2) UNION ALL SELECT vec_id_b, distance FROM prs WHERE distance <= 8.0 AND vec_id_a % 5 IN (1, 2) AND vec_id_b % 5 IN (1, 2)),
       st AS (SELECT v, count(*)::DOUBLE AS n, min(d) AS lo, round(avg(d), 6) AS mid, max(d) AS hi FROM e GROUP BY 1)
       SELECT vec_id, sum(neighbor_count) FILTER (shell = 'shell_1')::DOUBLE AS shell_1_neighbor_count, sum(charge_sum) FILTER (shell = 'shell_3')::DOUBLE AS shell_3_charge_sum, coalesce(max(n), 0) AS neighbor_sites,
         round(coalesce(max(lo), 0), 6) AS min_distance, coalesce(max(mid), 0) AS mean_distance, round(coalesce(max(hi), 0), 6) AS max_distance FROM sh LEFT JOIN st ON v = vec_id GROUP BY 1""")
def site_feature_pivot(spark, sf_dir):
    sites, shells = sites_and_shells(spark, sf_dir)
    wide = P.site_feature_pivot(shells, P.near_pairs(sites, "structure", "vec_id", 8.0), "structure", "vec_id", ["neighbor_count", "charge_sum"],
                                ["shell_1", "shell_2", "shell_3"])
    return wide.select("vec_id", "shell_1_neighbor_count", "shell_3_charge_sum", "neighbor_sites",
                       *[F.round(c, 6).alias(c) for c in ("min_distance", "mean_distance", "max_distance")])


NEAREST_SQL = f"""WITH {PTS_SQL}, r AS (SELECT *, CASE WHEN residue IN ('LYS', 'ARG') THEN 1 WHEN residue IN ('ASP', 'GLU') THEN -1 ELSE 0 END AS sgn FROM pts WHERE residue <> 'ALA'),
nr AS (SELECT r.vec_id, r.structure, r.residue, (SELECT min(distance) FROM dir JOIN r o ON o.vec_id = q WHERE p = r.vec_id AND o.sgn * r.sgn > 0 AND distance <= 6) AS same,
  (SELECT min(distance) FROM dir JOIN r o ON o.vec_id = q WHERE p = r.vec_id AND o.sgn * r.sgn < 0 AND distance <= 6) AS opposite,
  (SELECT min(d) FROM (SELECT CASE WHEN m.vec_id = r.vec_id THEN 0 ELSE sqrt((m.x - r.x) * (m.x - r.x) + (m.y - r.y) * (m.y - r.y) + (m.z - r.z) * (m.z - r.z)) END AS d FROM pts m WHERE m.structure = r.structure AND m.element = 'ZN') WHERE d <= 5) AS metal FROM r)"""


def nearest(spark, sf_dir):
    p = points(spark, sf_dir)
    sign = F.when(F.col("residue").isin("LYS", "ARG"), 1).when(F.col("residue").isin("ASP", "GLU"), -1).otherwise(0)
    residues = p.filter("residue <> 'ALA'").withColumn("sgn", sign)
    return P.nearest_charges(residues, p.filter("element = 'ZN'"), "structure", "vec_id", "sgn")


@query("nearest_charges", "C16", NEAREST_SQL + " SELECT vec_id, round(same, 6) AS same, round(opposite, 6) AS opposite, round(metal, 6) AS metal FROM nr")
def nearest_charges(spark, sf_dir):
    return nearest(spark, sf_dir).select("vec_id", *[F.round(c, 6).alias(c) for c in ("same", "opposite", "metal")])


@query("physics_summary", "D17 G28",
       NEAREST_SQL + """, ms AS (SELECT *, CASE WHEN residue IN ('ASP', 'GLU') THEN greatest(-1.0, least(0.0, -1.0 + CASE WHEN same < 4 THEN 0.35 ELSE 0 END - CASE WHEN opposite < 4.5 THEN 0.2 ELSE 0 END - CASE WHEN metal < 3.2 THEN 0.25 ELSE 0 END))
         WHEN residue IN ('LYS', 'ARG') THEN greatest(0.0, least(1.0, 1.0 - CASE WHEN same < 4 THEN 0.25 ELSE 0 END + CASE WHEN opposite < 4.5 THEN 0.1 ELSE 0 END))
         WHEN residue = 'HIS' THEN CASE WHEN metal < 3.2 THEN 0.7 WHEN opposite < 4 THEN 0.5 WHEN same < 4 THEN 0.1 ELSE 0 END WHEN metal < 3.0 THEN -0.4 WHEN opposite < 4 THEN -0.2 ELSE 0 END AS charge FROM nr)
       SELECT structure, count(*) AS record_count, round(CAST(sum(charge) AS DOUBLE), 4) AS net_charge, round(avg(abs(charge))::DOUBLE, 4) AS mean_abs_charge, count(*) FILTER (charge > 0.2) AS positive_count, count(*) FILTER (charge < -0.2) AS negative_count,
         count(*) FILTER (same < 4.5) AS same_contacts, count(*) FILTER (opposite < 4.5) AS opposite_contacts, count(*) FILTER (metal < 3.2) AS metal_contacts,
         round(coalesce(sum(1 / greatest(same, 0.1)) FILTER (residue IN ('ASP', 'GLU') AND same < 4), 0), 4) AS acidic_penalty FROM ms GROUP BY 1""")
def physics_summary(spark, sf_dir):
    n = nearest(spark, sf_dir)
    ms = n.withColumn("charge", S.microstate(F.col("residue"), F.col("same"), F.col("opposite"), F.col("metal"))["adjusted_charge"])
    return P.physics_summary(ms, "structure").drop("balance")


@query("radius_semi_join", "C17 B13", f"WITH {PTS_SQL} SELECT DISTINCT p AS vec_id FROM dir WHERE distance <= 3 AND q % 25 = 0 UNION SELECT vec_id FROM pts WHERE vec_id % 25 = 0")
def radius_semi_join(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.scope_points(p, "structure", "vec_id", "shell", p.filter("vec_id % 25 = 0"), radius=3.0).select("vec_id")


@query("interface_scope", "B13",
       f"WITH {PTS_SQL} SELECT vec_id FROM pts WHERE structure < 5 AND vec_id % 10 = 0 UNION ALL SELECT vec_id FROM pts WHERE structure NOT IN (SELECT structure FROM pts WHERE structure < 5 AND vec_id % 10 = 0) AND chain = 'A'")
def interface_scope(spark, sf_dir):
    p = points(spark, sf_dir)
    focus = p.filter("structure < 5 AND vec_id % 10 = 0")
    chains = p.select("structure", F.lit("A").alias("chain")).distinct()
    return P.scope_points(p, "structure", "vec_id", "interface_only", focus, chains).select("vec_id")


@query("site_fragments", "C32 C30", f"WITH {PTS_SQL} SELECT p AS site, q AS atom, round(distance, 6) AS distance FROM dir WHERE distance <= 6 AND p % 20 = 0 AND q % 5 <> 4 UNION ALL SELECT vec_id, vec_id, 0.0 FROM pts WHERE vec_id % 20 = 0")
def site_fragments(spark, sf_dir):
    p = points(spark, sf_dir)
    return P.fragments(p.filter("vec_id % 20 = 0").withColumn("site", F.col("vec_id")), p.withColumn("atom", F.col("vec_id")),
                       "structure", "site", "atom").select("site", "atom", "distance")


@query("structure_descriptors", "D15",
       f"""WITH {PTS_SQL}, r AS (SELECT structure, vec_id // 3 AS res, count(*) AS n, sum(CASE WHEN vec_id % 5 <> 4 THEN 1 ELSE 0 END) AS h, sum(20.0 + vec_id % 17) AS b, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM pts GROUP BY 1, 2)
       SELECT structure, CAST(sum(n) AS BIGINT) AS atom_count, round(sum(h) / sum(n)::DOUBLE, 6) AS heavy_fraction, round(CAST(sum(b) AS DOUBLE) / sum(n)::DOUBLE, 6) AS mean_b_factor, 1.0::DOUBLE AS mean_occupancy, count(*) AS residue_count, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS radius_of_gyration FROM r GROUP BY 1""")
def structure_descriptors(spark, sf_dir):
    return P.structure_descriptors(points(spark, sf_dir).withColumn("res", F.floor(F.col("vec_id") / 3)), "structure", "res")


@query("sequence_composition", "D16",
       """WITH t AS (SELECT doc_id, length(text) AS length, len(regexp_extract_all(text, '[ACDEFGHIKLMNPQRSTVWY]')) AS k, text FROM documents),
       h AS (SELECT *, list_sum(list_transform(['A:18', 'C:25', 'D:-35', 'E:-35', 'F:28', 'G:-4', 'H:-32', 'I:45', 'K:-39', 'L:38', 'M:19', 'N:-35', 'P:-16', 'Q:-35', 'R:-45', 'S:-8', 'T:-7', 'V:42', 'W:-9', 'Y:-13'],
          lambda p: CAST(split_part(p, ':', 2) AS INT) * (length(text) - length(replace(text, left(p, 1), ''))))) AS s FROM t)
       SELECT doc_id, length, round(CASE WHEN k > 0 THEN s / 10.0::DOUBLE / k END, 6) + 0.0::DOUBLE AS mean_hydropathy, round(CASE WHEN k > 0 THEN len(regexp_extract_all(text, '[FWYH]')) / k::DOUBLE END, 6) AS aromatic_fraction,
         round(CASE WHEN k > 0 THEN len(regexp_extract_all(text, '[DEKRH]')) / k::DOUBLE END, 6) AS charged_fraction, round(CASE WHEN k > 0 THEN len(regexp_extract_all(text, '[NQSTYCHDEKR]')) / k::DOUBLE END, 6) AS polar_fraction FROM h""")
def sequence_composition(spark, sf_dir):
    return P.sequence_composition(table(spark, sf_dir, "documents"), "doc_id", "text")


TRAITS_SQL = """, tr AS (SELECT *, CASE WHEN residue IN ('LYS', 'ARG') THEN 1.0 WHEN residue IN ('ASP', 'GLU') THEN -1.0 ELSE 0.0 END AS qq, residue IN ('ALA', 'CYS') AS hyd, residue IN ('HIS', 'TYR') AS aro FROM pts),
ct AS (SELECT p.structure, vec_id_a, vec_id_b, CASE WHEN a.qq * b.qq < 0 THEN 'salt_bridge' WHEN a.hyd AND b.hyd THEN 'hydrophobic_contact' WHEN a.aro AND b.aro AND distance <= 6 THEN 'pi_stacking' ELSE 'distance_neighbor' END AS edge_type, round(distance, 6) AS distance
  FROM prs p JOIN tr a ON a.vec_id = vec_id_a JOIN tr b ON b.vec_id = vec_id_b WHERE distance <= 4),
cb AS (SELECT structure, vec_id AS vec_id_a, lead(vec_id) OVER w AS vec_id_b, 'covalent_bond' AS edge_type, round(sqrt((x - lead(x) OVER w) * (x - lead(x) OVER w) + (y - lead(y) OVER w) * (y - lead(y) OVER w) + (z - lead(z) OVER w) * (z - lead(z) OVER w)), 6) AS distance FROM tr WINDOW w AS (PARTITION BY structure, chain ORDER BY vec_id)),
ed AS (SELECT * FROM ct UNION ALL SELECT * FROM cb WHERE vec_id_b IS NOT NULL)"""


def residue_nodes(spark, sf_dir):
    r = F.col("residue")
    return points(spark, sf_dir).drop("charge").withColumn(
        "charge", F.when(r.isin("LYS", "ARG"), 1.0).when(r.isin("ASP", "GLU"), -1.0).otherwise(0.0)).withColumn(
        "hydrophobic", r.isin("ALA", "CYS")).withColumn("aromatic", r.isin("HIS", "TYR")).withColumn(
        "number", F.col("vec_id")).withColumn("secondary", pick(["helix", "sheet", ""], F.col("vec_id")))


@query("residue_graph_edges", "G26 E6 C13", f"WITH {PTS_SQL}{TRAITS_SQL} SELECT structure, vec_id_a, vec_id_b, edge_type, distance FROM ed")
def residue_graph_edges(spark, sf_dir):
    return P.residue_edges(residue_nodes(spark, sf_dir), "structure", "vec_id", "number", 4.0).withColumn("distance", F.round("distance", 6))


@query("atom_graph_edges", "G26",
       f"""WITH {PTS_SQL} SELECT p.structure, vec_id_a, vec_id_b, CASE WHEN distance <= 1.9 THEN 'covalent_bond' WHEN a.element = 'ZN' OR b.element = 'ZN' THEN 'metal_coordination'
         WHEN (a.element, b.element) IN (('N', 'O'), ('O', 'N')) AND distance <= 3.5 THEN 'hydrogen_bond' WHEN a.charge * b.charge < 0 AND distance <= 4.5 THEN 'salt_bridge'
         WHEN a.residue IN ('HIS', 'TYR') AND b.residue IN ('HIS', 'TYR') AND distance <= 5.5 THEN 'pi_stacking' WHEN distance <= 3.4 THEN 'hydrophobic_contact' ELSE 'distance_neighbor' END AS edge_type
       FROM prs p JOIN pts a ON a.vec_id = vec_id_a JOIN pts b ON b.vec_id = vec_id_b WHERE distance <= 5""")
def atom_graph_edges(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("metal", F.col("element") == "ZN").withColumn(
        "role", F.when(F.col("element") == "N", "donor").when(F.col("element") == "O", "acceptor").otherwise("")).withColumn(
        "aromatic", F.col("residue").isin("HIS", "TYR")).withColumn("radius", F.lit(1.7))
    return P.atom_edges(p, "structure", "vec_id", 5.0).select("structure", "vec_id_a", "vec_id_b", "edge_type")


@query("structural_graph_summary", "D21",
       f"""WITH {PTS_SQL}{TRAITS_SQL} SELECT n.structure, node_count, helix_count, sheet_count, coil_count, edge_count, salt_bridge_count, pi_stacking_count FROM
         (SELECT structure, count(*) AS node_count, count(*) FILTER (vec_id % 3 = 0) AS helix_count, count(*) FILTER (vec_id % 3 = 1) AS sheet_count, count(*) FILTER (vec_id % 3 = 2) AS coil_count FROM pts GROUP BY 1) n
         LEFT JOIN (SELECT structure, count(*) AS edge_count, count(*) FILTER (edge_type = 'salt_bridge') AS salt_bridge_count, count(*) FILTER (edge_type = 'pi_stacking') AS pi_stacking_count FROM ed GROUP BY 1) e USING (structure)""")
def structural_graph_summary(spark, sf_dir):
    nodes = residue_nodes(spark, sf_dir)
    return P.graph_summary(nodes, P.residue_edges(nodes, "structure", "vec_id", "number", 4.0), "structure").select(
        "structure", "node_count", "helix_count", "sheet_count", "coil_count", "edge_count", "salt_bridge_count", "pi_stacking_count")


@query("indexed_graph_edges", "C24 G26",
       f"""WITH {PTS_SQL}{TRAITS_SQL}, ix AS (SELECT structure, vec_id, row_number() OVER (PARTITION BY structure ORDER BY vec_id) - 1 AS i FROM pts WHERE vec_id % 7 <> 3),
       k AS (SELECT ed.structure, a.i AS s, b.i AS t, edge_type FROM ed JOIN ix a ON a.vec_id = vec_id_a JOIN ix b ON b.vec_id = vec_id_b)
       SELECT structure, s AS source_index, t AS target_index, edge_type FROM k UNION ALL SELECT structure, t, s, edge_type FROM k""")
def indexed_graph_edges(spark, sf_dir):
    nodes = residue_nodes(spark, sf_dir)
    edges = P.residue_edges(nodes, "structure", "vec_id", "number", 4.0)
    return P.indexed_edges(nodes.filter("vec_id % 7 <> 3").withColumn("o", F.col("vec_id")), edges, "structure", "vec_id", "o")


@query("edge_vectors", "G26",
       f"""WITH {PTS_SQL}{TRAITS_SQL} SELECT vec_id_a, vec_id_b, distance, CASE WHEN edge_type = 'covalent_bond' THEN 1.0 ELSE 0.0 END::DOUBLE AS v1, CASE WHEN edge_type = 'salt_bridge' THEN 1.0 ELSE 0.0 END::DOUBLE AS v3 FROM ed""")
def edge_vectors(spark, sf_dir):
    e = P.residue_edges(residue_nodes(spark, sf_dir), "structure", "vec_id", "number", 4.0)
    v = S.edge_vector(F.col("edge_type"), F.round("distance", 6))
    return e.select("vec_id_a", "vec_id_b", v.alias("v")).select("vec_id_a", "vec_id_b", F.col("v")[0].alias("distance"),
                                                                 F.col("v")[1].alias("v1"), F.col("v")[3].alias("v3"))
