"""Filter, gate and issue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import measurements as M
from affinityloom.operators import release as R
from affinityloom.plans import domain as D
from affinityloom.plans.joins import MASTER_SQL, pair_master_frame
from affinityloom.plans.registry import query, table
from affinityloom.plans.scalars import LINE_KEY_SQL, line_keys


@query("search_predicate", "B1 G33",
       """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice <= 300000 AND o_custkey >= 2
         AND o_orderkey BETWEEN 100 AND 1000000000 AND (o_custkey >= 1 AND o_totalprice > 0 OR o_custkey >= 2) AND o_orderdate >= '1994-01-01' AND o_orderdate < '1998-01-01'""")
def search_predicate(spark, sf_dir):
    c = R.SearchCriteria(methods=["1-URGENT", "2-HIGH"], max_resolution=300000.0, min_protein_entities=2, require_protein=True,
                         ranges={"id": (100, 1000000000)}, task_types=["protein_ligand", "protein_protein"], release_years=(1994, 1997))
    cols = {"method": "o_orderpriority", "resolution": "o_totalprice", "proteins": "o_custkey", "nonpolymers": "o_totalprice",
            "id": "o_orderkey", "released": "o_orderdate"}
    return table(spark, sf_dir, "orders").filter(R.search_predicate(c, cols)).select("o_orderkey", "o_totalprice")


@query("constraint_violations", "B2",
       """SELECT doc_id, concat_ws(',', CASE WHEN n_chars / 10000.0 > 1 THEN 'quality_score_range' END, CASE WHEN doc_id % 20 > 14 THEN 'ph_range' END,
         CASE WHEN doc_id % 50 = 0 THEN 'resolution_positive' END, CASE WHEN doc_id % 9 = 0 THEN 'ionic_strength_non_negative' END,
         CASE WHEN lang = 'fr' THEN 'provenance_has_ingested_at' END, CASE WHEN source = 'src7' THEN 'task_type' END) AS violations FROM documents""")
def constraint_violations(spark, sf_dir):
    n = F.col("doc_id")
    cols = {"score": F.col("n_chars") / 10000.0, "ph": n % 20, "resolution": n % 50, "temperature": n * 1.0,
            "ionic": F.when(n % 9 == 0, -1.0).otherwise(0.1), "ingested_at": F.when(F.col("lang") != "fr", "2024"),
            "task": F.when(F.col("source") == "src7", "other").otherwise("protein_ligand")}
    v = R.constraint_violations(cols, ["protein_ligand", "protein_protein", "mutation_ddg"])
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(v, ",").alias("violations"))


@query("unknown_feature_keys", "B2",
       """SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN '' ELSE event_type END AS unknown FROM events""")
def unknown_feature_keys(spark, sf_dir):
    m = F.create_map(F.lit("k"), F.lit(1.0), F.col("event_type"), F.col("value"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(R.unknown_keys(m, ["k", "view", "click"]), ",").alias("unknown"))


@query("selection_mode_filter", "B6",
       f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN pair_key LIKE '%wt_or_unspecified' THEN 'filtered_by_mode' ELSE 'kept' END AS outcome FROM ({LINE_KEY_SQL})""")
def selection_mode_filter(spark, sf_dir):
    from affinityloom.functions.keys import mutation_family, parse_pair_key
    family = mutation_family(parse_pair_key("pair_key")["mutation"])
    keep = R.mode_keeps("mutation_effect", F.col("task"), family, F.lit(0.0))
    return line_keys(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey",
                                           F.when(keep, "kept").otherwise("filtered_by_mode").alias("outcome"))


SUMM_SQL = """summ AS (SELECT pair_key, kind, count(*) AS n, count(log_value) AS nv, max(log_value) - min(log_value) AS spread,
    CAST(min(CASE source WHEN 'SKEMPI' THEN 1 WHEN 'PDBbind' THEN 2 WHEN 'BioLiP' THEN 3 WHEN 'BindingDB' THEN 4 ELSE 5 END) AS INT) AS p FROM assays GROUP BY 1, 2),
  pairs AS (SELECT m.*, s.n, s.nv, s.spread, s.nv >= 2 AND s.spread >= 0.3 AS conflict_flag,
    CASE WHEN s.nv < 2 THEN NULL WHEN s.spread < 0.3 THEN 'agreement_within_0.3_log10' WHEN s.spread < 1 THEN printf('moderate_conflict_spread=%.3f', s.spread) ELSE printf('high_conflict_spread=%.3f', s.spread) END AS conflict_summary,
    (['SKEMPI', 'PDBbind', 'BioLiP', 'BindingDB', 'ChEMBL'])[s.p] AS preferred_source FROM master m JOIN summ s USING (pair_key, kind))"""


def release_pairs(spark, sf_dir):
    from affinityloom.functions.hashing import hash_split
    # Dealt by pair key and given to the pair master with the splits, so that its rows aren't moved for the summary.
    a = D.assays(spark, sf_dir).select("pair_key", "kind", "source", "log_value").repartition("pair_key")
    summary = M.group_summary(a, ["pair_key", "kind"], "source", "log_value").drop("sources", "preferred_rationale")
    facts = summary.withColumn("split", hash_split(F.concat_ws("|", "pair_key", "kind")))
    level = lambda c, n: F.when(c, n).otherwise("high")
    conf = F.create_map(
        F.lit("binding_affinity_type"), level(F.col("kind") == "N", "medium"),
        F.lit("binding_affinity_log10_standardized"), level(F.col("log_value").isNull(), "unknown"),
        F.lit("pair_identity_key"), level(F.col("pair_key").endswith("wt"), "medium"))
    return pair_master_frame(spark, sf_dir, facts).withColumn("confidence", conf).withColumn(
        "override_used", F.lit(False)).withColumn("is_mutant", F.col("pair_key").endswith("A12V"))


PAIR_ISSUES_SQL = """pi AS (SELECT entry_id, pair_key, 'no_matched_interface' AS issue_type, 'no interface matched' AS details FROM pairs WHERE matching_interface_count = 0
  UNION ALL SELECT entry_id, pair_key, 'ambiguous_mutation_context', 'mutation unknown' FROM pairs WHERE contains(pair_key, 'mutation_unknown')
  UNION ALL SELECT entry_id, pair_key, 'source_value_conflict', conflict_summary FROM pairs WHERE conflict_flag
  UNION ALL SELECT entry_id, pair_key, 'non_high_confidence_assay_fields', concat_ws('; ', CASE WHEN log_value IS NULL THEN 'binding_affinity_log10_standardized' END, CASE WHEN kind = 'N' THEN 'binding_affinity_type' END) FROM pairs WHERE log_value IS NULL OR kind = 'N'
  UNION ALL SELECT entry_id, pair_key, 'advisory_non_high_confidence_assay_fields', 'pair_identity_key' FROM pairs WHERE pair_key LIKE '%wt')"""
ENTRY_ISSUES_SQL = """md AS (SELECT entry_id, array_to_string(list_sort(list(DISTINCT component_id)), '; ') AS missing FROM objects WHERE component_type IN ('small_molecule', 'cofactor') AND inchikey = '' GROUP BY 1),
  ei AS (SELECT entry_id, 'missing_structure_file' AS issue_type, 'no structure path' AS details FROM entries WHERE structure_path = ''
  UNION ALL SELECT entry_id, 'no_assay_data', 'no assay rows' FROM entries WHERE entry_id NOT IN (SELECT entry_id FROM assays)
  UNION ALL SELECT entry_id, 'non_high_confidence_fields', 'method' FROM entries WHERE method = '5-LOW'
  UNION ALL SELECT entry_id, 'missing_ligand_descriptors', missing FROM entries JOIN md USING (entry_id))"""


def entry_issue_frame(spark, sf_dir):
    e = D.entries(spark, sf_dir).withColumn("confidence", F.create_map(
        F.lit("method"), F.when(F.col("method") == "5-LOW", "low").otherwise("high"), F.lit("title"), F.lit("")))
    counts = D.assays(spark, sf_dir).groupBy("entry_id").agg(F.count(F.lit(1)).alias("assay_count"))
    bare = D.objects(spark, sf_dir).filter("component_type IN ('small_molecule', 'cofactor') AND inchikey = ''").groupBy("entry_id").agg(
        F.array_join(F.sort_array(F.collect_set("component_id")), "; ").alias("missing_components"))
    return R.entry_issues(e, counts, bare)


@query("entry_issues", "B9", f"WITH {D.DOMAIN_SQL}, {ENTRY_ISSUES_SQL} SELECT 'entry' AS scope, entry_id, '' AS pair_key, issue_type, details FROM ei")
def entry_issues(spark, sf_dir):
    return entry_issue_frame(spark, sf_dir)


@query("pair_issues", "B9", MASTER_SQL + f", {SUMM_SQL}, {PAIR_ISSUES_SQL} SELECT 'pair' AS scope, * FROM pi")
def pair_issues(spark, sf_dir):
    return R.pair_issues(release_pairs(spark, sf_dir))


@query("model_ready_gate", "B7",
       MASTER_SQL + f""", {SUMM_SQL}, {PAIR_ISSUES_SQL}, {ENTRY_ISSUES_SQL},
       k AS (SELECT entry_id, pair_key, issue_type FROM pi UNION SELECT p.entry_id, p.pair_key, ei.issue_type FROM pairs p JOIN ei USING (entry_id)),
       g AS (SELECT entry_id, pair_key, list_sort(list(DISTINCT issue_type)) AS kinds FROM k GROUP BY ALL)
       SELECT p.pair_key, p.kind, p.value, coalesce(array_to_string(kinds, '; '), '') AS issue_types,
         coalesce(array_to_string(list_sort(list_concat(list_filter(coalesce(kinds, []), lambda x: x IN ('ambiguous_mutation_context', 'missing_structure_file', 'no_matched_interface', 'non_high_confidence_assay_fields', 'source_value_conflict')),
           CASE WHEN p.log_value IS NULL THEN ['missing_standardized_affinity'] ELSE [] END)), '; '), '') AS exclusion_reasons
       FROM pairs p LEFT JOIN g USING (entry_id, pair_key)""")
def model_ready_gate(spark, sf_dir):
    return R.gate_own_pairs(release_pairs(spark, sf_dir), entry_issue_frame(spark, sf_dir)).select("pair_key", "kind", "value", "issue_types", "exclusion_reasons")


@query("conflict_extract", "B8",
       MASTER_SQL + f", {SUMM_SQL} SELECT entry_id, pair_key, kind, source, value, conflict_summary FROM pairs WHERE conflict_flag")
def conflict_extract(spark, sf_dir):
    p = release_pairs(spark, sf_dir).filter("conflict_flag")
    return p.select("entry_id", "pair_key", "kind", "source", "value", "conflict_summary").orderBy(
        "entry_id", "pair_key", "kind", "source", "value")


@query("canonical_release_projection", "B16 D34",
       MASTER_SQL + f""", {SUMM_SQL} SELECT pair_key, kind, value, CASE WHEN pair_key LIKE '%|wt' OR pair_key LIKE '%|wt_or_unspecified' THEN 'wt' ELSE split_part(pair_key, '|', 5) END AS mutation_strings,
         coalesce(conflict_summary, CASE WHEN conflict_flag THEN 'conflict_flagged_without_spread_summary' WHEN n <= 1 THEN 'single_measurement_no_cross_source_conflict_assessment'
           WHEN log_value IS NULL AND nv = 0 THEN 'multiple_measurements_without_standardized_affinity_conflict_assessment' ELSE 'multiple_measurements_without_explicit_conflict_summary' END) AS summary FROM pairs""")
def canonical_release_projection(spark, sf_dir):
    p = release_pairs(spark, sf_dir)
    c = R.conflict_defaults(F.col("conflict_summary"), F.col("agreement_band"), F.col("measurement_count"), F.col("conflict_flag"),
                            F.col("log_value"), F.col("mean_log10"))
    return p.select("pair_key", "kind", "value",
                    R.mutation_strings(F.lit(""), F.split("pair_key", r"\|")[4]).alias("mutation_strings"), c["summary"].alias("summary"))


@query("input_resolution", "B12",
       """SELECT resolution_status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'missing_structure_reference' WHEN o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) THEN 'structure_file_missing_on_disk' ELSE 'resolved' END AS resolution_status FROM orders) GROUP BY 1""")
def input_resolution(spark, sf_dir):
    listing = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("/s/"), F.col("l_orderkey").cast("string"), F.lit(".cif")).alias("file_path"))
    return R.input_resolution(D.entries(spark, sf_dir), listing, "structure_path").groupBy("resolution_status").agg(F.count(F.lit(1)).alias("n"))


@query("split_readiness", "D9",
       MASTER_SQL + """SELECT 'hash' AS strategy, 'exploratory' AS strategy_family, count(*) AS pair_count, count(*) AS assigned_count,
         count(*) FILTER (split <> 'train') AS held_out_count, 1.0::DOUBLE AS coverage, 'ready' AS diagnostic_status FROM master""")
def split_readiness(spark, sf_dir):
    return R.split_readiness("hash", pair_master_frame(spark, sf_dir), "split", "ready")


@query("release_readiness", "D34",
       f"""WITH {D.DOMAIN_SQL} SELECT CASE WHEN c > 0 THEN 'blocked' ELSE 'ready' END AS release_status, CASE WHEN c > 0 THEN 'missing_structures' ELSE '' END AS blockers,
         CASE WHEN a > 0 THEN 'missing_log_values' ELSE '' END AS warnings FROM (SELECT count(*) FILTER (structure_path = '') AS c, (SELECT count(*) FROM assays WHERE log_value IS NULL) AS a FROM entries)""")
def release_readiness(spark, sf_dir):
    e = D.entries(spark, sf_dir).agg(F.count_if(F.col("structure_path") == "").alias("c"), F.lit(1).alias("_one"))
    a = D.assays(spark, sf_dir).agg(F.count_if(F.col("log_value").isNull()).alias("a"), F.lit(1).alias("_one"))
    return R.release_readiness(e.join(a, "_one"), {"missing_structures": F.col("c") > 0, "empty": F.lit(False)},
                               {"missing_log_values": F.col("a") > 0})
