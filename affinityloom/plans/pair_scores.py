"""Pair scoring and interface support over the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import pair_scores as PS
from affinityloom.plans.joins import MASTER_SQL, pair_master_frame
from affinityloom.plans.registry import query, table
from affinityloom.plans.scalars import pick, sql_pick

BANDS = ["high", "medium", "low", ""]

SCORED_SQL = f"""WITH t AS (SELECT p_partkey, list_distinct(string_split(lower(p_name || ' ' || p_type), ' ')) AS tk FROM part),
q AS (SELECT p_partkey AS query, tk FROM t WHERE p_partkey % 100 = 0),
p AS (SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord, l_partkey, l_orderkey, CASE WHEN l_suppkey % 11 > 0 THEN round(log10(l_extendedprice), 6) END AS lv,
  unnest(list_distinct(['U' || l_suppkey, 'U' || (l_suppkey % 7)])) AS target, {sql_pick(BANDS, 'l_linenumber')} AS band, l_tax > 0.05 AS conflict, l_discount * 10 AS quality FROM lineitem),
b AS (SELECT *, 0.25 * CASE WHEN lv IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - lv / 6)) END + 0.10 * least(greatest(quality, 0.0), 1.0)
  + CASE band WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.1 WHEN 'low' THEN -0.05 ELSE 0.0 END - CASE WHEN conflict THEN 0.1 ELSE 0.0 END AS base FROM p),
s AS (SELECT query, p_partkey, len(list_intersect(q.tk, t.tk)) / (len(q.tk) + len(t.tk) - len(list_intersect(q.tk, t.tk)))::DOUBLE AS sim FROM q, t),
x AS (SELECT query, target, ord, l_orderkey, lv, band, sim, round(0.55 * sim + base, 9) AS score FROM b JOIN s ON p_partkey = l_partkey),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query, target ORDER BY score DESC, ord) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ord, target) AS rank FROM y QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, ord, target) <= 25)
SELECT query, rank, target, l_orderkey, band, round(sim, 4) AS similarity, round(1 / (1 + exp(-score)), 4) AS confidence, round(-1.364 * lv, 3) AS free_energy,
  CASE WHEN lv IS NULL THEN 'unknown' WHEN lv <= 3 THEN 'strong_binder_predicted' WHEN lv <= 4 THEN 'binder_predicted' WHEN lv <= 5 THEN 'weak_binder_predicted' ELSE 'unlikely_binder' END AS binding_call FROM r"""


def scored_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("tokens"))
    supp = F.col("l_suppkey")
    named = lambda c: F.concat(F.lit("U"), c.cast("string"))
    order = F.col("l_orderkey") * 1_000_000_000 + F.col("l_linenumber") * 100_000_000 + F.col("l_partkey") * 1000 + supp % 1000
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", order.alias("order"), F.array_distinct(F.array(named(supp), named(supp % 7))).alias("targets"),
        F.when(supp % 11 > 0, F.round(F.log10("l_extendedprice"), 6)).alias("log_value"), (F.col("l_discount") * 10).alias("quality"),
        pick(BANDS, F.col("l_linenumber")).alias("band"), (F.col("l_tax") > 0.05).alias("conflict")).join(part, "l_partkey")
    queries = part.where("l_partkey % 100 = 0").select(F.col("l_partkey").alias("query"), "tokens")
    return queries, PS.with_base_score(rows, "log_value", "quality", "band", "conflict")


@query("pair_score_targets", "H7", SCORED_SQL)
def pair_score_targets(spark, sf_dir):
    queries, pairs = scored_pairs(spark, sf_dir)
    ranked = PS.best_targets(queries, pairs, ["l_orderkey", "band", "log_value"])
    return PS.described(ranked, "log_value").select(
        "query", "rank", "target", "l_orderkey", "band", "similarity", "confidence", "free_energy", "binding_call")


SUPPORT_SQL = MASTER_SQL + """, x AS (SELECT unnest(string_split(accession, '; ')) AS target, matching_interface_count AS n, source FROM master),
g AS (SELECT target, count(*) AS support_count, max(n) AS max_matching_interface_count, array_to_string(list_sort(list(DISTINCT source)), ';') AS source_databases,
  round(sum(1 + 0.1 * n + CASE WHEN source IN ('BioLiP', 'SKEMPI') THEN 0.2 ELSE 0.0 END), 6) AS score FROM x WHERE target <> '' GROUP BY 1)
SELECT target, row_number() OVER (ORDER BY score DESC, target) AS rank, support_count, max_matching_interface_count, source_databases FROM g"""


@query("interface_support", "H7", SUPPORT_SQL)
def interface_support(spark, sf_dir):
    rows = pair_master_frame(spark, sf_dir).select(
        F.explode(F.split("accession", "; ")).alias("target"), "matching_interface_count", "source").where("target <> ''")
    return PS.interface_support(rows, "target", "matching_interface_count", "source")
