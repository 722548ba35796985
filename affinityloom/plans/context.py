"""Query-context features and site-pipeline example rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import features as X
from affinityloom.plans import domain as D
from affinityloom.plans import spatial as SP
from affinityloom.plans.registry import query, table


@query("interface_residue_summary", "C33",
       """WITH d AS (SELECT l_suppkey, l_partkey AS residue, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY o, residue) AS n FROM d)
       SELECT l_suppkey, count(*) AS residue_count, CAST(sum(residue) FILTER (n <= 50) AS BIGINT) AS head_sum FROM r GROUP BY 1""")
def interface_residue_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_partkey").alias("residue"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), F.col("l_partkey").alias("p")).alias("o"))
    r = X.interface_residue_summary(rows, "l_suppkey", "residue", "o")
    total = F.aggregate(F.split("residues", ","), F.lit(0).cast("bigint"), lambda s, x: s + x.cast("bigint"))
    return r.select("l_suppkey", "residue_count", total.alias("head_sum"))


@query("query_context_features", "C33",
       f"""WITH {SP.PTS_SQL} SELECT structure, 'points.n' AS feature, count(*)::DOUBLE AS value FROM pts GROUP BY 1 UNION ALL SELECT structure, 'points.charge', sum(charge) FROM pts GROUP BY 1
       UNION ALL SELECT structure, 'contacts.pairs', count(*)::DOUBLE FROM prs WHERE distance <= 2.5 GROUP BY 1""")
def query_context_features(spark, sf_dir):
    p = SP.points(spark, sf_dir)
    pairs = SP.near_pairs(spark, sf_dir)
    return X.query_context_features("structure", {
        "points": p.groupBy("structure").agg(F.count(F.lit(1)).alias("n"), F.sum("charge").alias("charge"), F.min("element").alias("note")),
        "contacts": pairs.groupBy("structure").agg(F.count(F.lit(1)).alias("pairs"))})


@query("site_example_rows", "G32",
       """SELECT 'R' || o.o_orderkey AS record_id, CASE WHEN l_orderkey IS NOT NULL THEN 'R' || o.o_orderkey || ':' || l_linenumber END AS example_id, CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS kd,
         CASE l_returnflag WHEN 'A' THEN 'Kd' WHEN 'R' THEN 'Ki' END AS class_label, CASE WHEN l_orderkey IS NULL THEN 'inference_ready_only' ELSE 'protein_ligand' END AS task, l_orderkey IS NOT NULL AS supervised
       FROM orders o LEFT JOIN lineitem ON l_orderkey = o_orderkey""")
def site_example_rows(spark, sf_dir):
    records = table(spark, sf_dir, "orders").select(D.numbered("R", F.col("o_orderkey")).alias("record_id"))
    flag = F.col("l_returnflag")
    pairs = table(spark, sf_dir, "lineitem").select(
        D.numbered("R", F.col("l_orderkey")).alias("record_id"), F.col("l_linenumber").alias("position"), F.concat(F.lit("protein_ligand|"), F.col("l_partkey").cast("string")).alias("pair_key"),
        F.when(flag == "A", "Kd").when(flag == "R", "Ki").otherwise("").alias("kind"), F.col("l_extendedprice").alias("value"), F.lit(1.0).alias("mean"))
    return X.site_example_rows(records, pairs, "record_id").select("record_id", "example_id", "kd", "class_label", "task", "supervised")
