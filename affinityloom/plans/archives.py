"""Archive index and the skip rule, over archives and manifests that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.plans.registry import query, table
from affinityloom.sources import archives as AR
from affinityloom.sources import scans as SC

MEMBERS_PER_ARCHIVE = 500


@query("archive_index_resumed", "I5 A19",
       """SELECT 'C' || c_custkey AS accession, 'AF-c' || c_custkey || '-F1-model_v' || (c_custkey % 4) AS entry_id, 'v' || (c_custkey % 4) AS model_version,
         'models/AF-c' || c_custkey || '-F1-model_v' || (c_custkey % 4) || '.pdb.gz' AS member, CAST(length(c_name) * (CASE WHEN c_custkey % 7 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS size_bytes FROM customer""")
def archive_index_resumed(spark, sf_dir):
    """Two runs of 100 members an archive, then one over the rest. Every tenth row also has a member that is no
    model, every seventh model comes twice (the later counts)."""
    root = SC.scratch_path(spark, "archives")
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    name = F.concat(F.lit("models/AF-c"), k.cast("string"), F.lit("-F1-model_v"), (k % 4).cast("string"), F.lit(".pdb.gz"))
    models = F.array(F.struct(name.alias("member"), F.col("c_name").alias("data")), F.struct(
        F.when(k % 10 == 0, F.concat(F.lit("notes-"), k.cast("string"), F.lit(".txt"))).alias("member"), F.lit("note").alias("data")), F.struct(
        F.when(k % 7 == 0, name).alias("member"), F.repeat("c_name", F.lit(2)).alias("data")))
    AR.write_archives(c.select(F.inline(models)).filter("member IS NOT NULL"), f"{root}/tar", "member", "data", MEMBERS_PER_ARCHIVE)
    for chunk in (100, 100, None):
        AR.index_archives(spark, f"{root}/tar", f"{root}/log", chunk)
    return AR.model_lookup(AR.archive_members(spark, f"{root}/log"))


@query("stale_inputs", "I1",
       """SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag <> 'R' AND l_shipdate >= o_orderdate + INTERVAL 60 DAY)""")
def stale_inputs(spark, sf_dir):
    """Orders as inputs, changed 60 days after their date; lines as outputs, valid unless returned."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_orderdate + INTERVAL 60 DAY").alias("modified"))
    built = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("modified"), (F.col("l_returnflag") != "R").alias("valid"))
    return SC.stale_inputs(orders, built, ["o_orderkey"], "modified", "valid").select("o_orderkey")
