"""Domain tables derived from the order tables: entries, assays, chains, objects, interfaces.

``ord`` is the explicit row order that the first-wins rules use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinityloom.plans.registry import table
from affinityloom.plans.scalars import pick, sql_pick

SOURCES = ["SKEMPI", "PDBbind", "BioLiP", "BindingDB", "ChEMBL"]

DOMAIN_SQL = f"""
entries AS (SELECT 'E' || o_orderkey AS entry_id, o_orderpriority AS method, o_totalprice / 100000.0::DOUBLE AS resolution,
  CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE '/s/' || o_orderkey || '.cif' END AS structure_path, o_orderstatus AS membrane FROM orders),
base AS (SELECT *, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord, 'E' || l_orderkey AS entry_id FROM lineitem),
assays AS (SELECT entry_id, ord, 'protein_ligand|' || entry_id || '|' || {sql_pick(['A', 'A,B', '-'], 'l_linenumber')} || '|C' || (l_partkey % 50) || '|'
    || {sql_pick(['wt_or_unspecified', 'A12V', 'mutation_unknown', 'wt'], 'l_suppkey')} AS pair_key,
  {sql_pick(['A', 'A,B', '-'], 'l_linenumber')} AS receptor_key, 'C' || (l_partkey % 50) AS ligand_key,
  l_returnflag AS kind, l_extendedprice AS value, CASE WHEN l_suppkey % 11 > 0 THEN log10(l_extendedprice) END AS log_value, {sql_pick(SOURCES, 'l_suppkey')} AS source FROM base),
chains AS (SELECT entry_id, ord, {sql_pick(['A', 'B', 'C'], 'l_linenumber')} AS chain_id, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'U' || l_suppkey END AS accession,
  'O' || (l_suppkey % 25) AS organism FROM base),
objects AS (SELECT entry_id, ord, 'C' || (l_partkey % 50) AS component_id, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'K' || (l_partkey % 40) END AS inchikey,
  'C' || ((l_partkey + 1) % 50) AS component_name, {sql_pick(['small_molecule', 'cofactor', 'metal_ion'], 'l_partkey')} AS component_type FROM base WHERE l_linenumber > 2),
interfaces AS (SELECT entry_id, ord, {sql_pick(['A', 'B,C', ''], 'l_linenumber')} AS chain_key, CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'C' || (l_partkey % 50) END AS partner,
  l_linestatus AS interface_type FROM base WHERE l_linenumber % 2 = 0)
"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "*", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("ord"),
        F.concat(F.lit("E"), F.col("l_orderkey").cast("string")).alias("entry_id"))


def numbered(prefix: str, c) -> object:
    return F.concat(F.lit(prefix), c.cast("string"))


def entries(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        numbered("E", F.col("o_orderkey")).alias("entry_id"), F.col("o_orderpriority").alias("method"),
        (F.col("o_totalprice") / 100000.0).alias("resolution"),
        F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.concat(F.lit("/s/"), F.col("o_orderkey").cast("string"), F.lit(".cif")))
        .alias("structure_path"), F.col("o_orderstatus").alias("membrane"))


def assays(spark, sf_dir) -> DataFrame:
    receptor = pick(["A", "A,B", "-"], F.col("l_linenumber"))
    ligand = numbered("C", F.col("l_partkey") % 50)
    mutation = pick(["wt_or_unspecified", "A12V", "mutation_unknown", "wt"], F.col("l_suppkey"))
    return base(spark, sf_dir).select(
        "entry_id", "ord", F.concat_ws("|", F.lit("protein_ligand"), "entry_id", receptor, ligand, mutation).alias("pair_key"),
        F.col("l_returnflag").alias("kind"), F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_suppkey") % 11 > 0, F.log10("l_extendedprice")).alias("log_value"),
        pick(SOURCES, F.col("l_suppkey")).alias("source"))


def keyed_assays(spark, sf_dir) -> DataFrame:
    parts = F.split("pair_key", r"\|")
    return assays(spark, sf_dir).withColumn(
        "receptor", F.filter(F.split(parts[2], ","), lambda x: ~x.isin("", "-"))).withColumn("ligand_key", parts[3])


def chains(spark, sf_dir) -> DataFrame:
    return base(spark, sf_dir).select(
        "entry_id", "ord", pick(["A", "B", "C"], F.col("l_linenumber")).alias("chain_id"),
        F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(numbered("U", F.col("l_suppkey"))).alias("accession"),
        numbered("O", F.col("l_suppkey") % 25).alias("organism"))


def objects(spark, sf_dir) -> DataFrame:
    return base(spark, sf_dir).filter("l_linenumber > 2").select(
        "entry_id", "ord", numbered("C", F.col("l_partkey") % 50).alias("component_id"),
        F.when(F.col("l_partkey") % 4 == 0, "").otherwise(numbered("K", F.col("l_partkey") % 40)).alias("inchikey"),
        numbered("C", (F.col("l_partkey") + 1) % 50).alias("component_name"),
        pick(["small_molecule", "cofactor", "metal_ion"], F.col("l_partkey")).alias("component_type"))


def interfaces(spark, sf_dir) -> DataFrame:
    key = pick(["A", "B,C", ""], F.col("l_linenumber"))
    return base(spark, sf_dir).filter("l_linenumber % 2 = 0").select(
        "entry_id", "ord", F.filter(F.split(key, ","), lambda x: x != "").alias("chains"),
        F.when(F.col("l_partkey") % 3 == 0, "").otherwise(numbered("C", F.col("l_partkey") % 50)).alias("partner"),
        F.col("l_linestatus").alias("interface_type"))
