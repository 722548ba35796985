"""Dump tables: a dump that Spark writes from the tables, scanned, split and joined again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.plans.registry import query, table
from affinityloom.sources import dumps as DU
from affinityloom.sources import scans as SC


def quoted(c: Column) -> Column:
    body = F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.coalesce(F.concat(F.lit("'"), body, F.lit("'")), F.lit("NULL"))


def bare(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def fields(width: int, given: dict[int, Column]) -> Column:
    return F.concat(F.lit("("), F.concat_ws(",", *[given.get(i, F.lit("NULL")) for i in range(width)]), F.lit(")"))


def statement(rows: DataFrame, name: str, *tuples: Column) -> DataFrame:
    return rows.select(F.concat(F.lit(f"INSERT INTO `{name}` VALUES "), F.concat_ws(",", *tuples), F.lit(";")).alias("value"))


def write_dump(spark, sf_dir: str, path: str) -> None:
    """Orders are reactant sets, customers ligands, suppliers polymers and nations articles; some ids come twice."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    p, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    where = lambda cond, value: F.when(cond, value)
    measure = lambda value, shown, organism: fields(9, {
        0: quoted(F.when(key % 2 == 0, F.lit("kinase [A12V]"))), 1: quoted(F.lit("inh")), 2: bare(cust), 3: quoted(F.lit("Ki")), 4: bare(value),
        5: quoted(shown), 6: F.lit("0"), 7: bare(key), 8: quoted(organism)})
    price = F.col("o_totalprice")
    homo, nobody = F.lit("Homo sapiens"), F.lit(None).cast("string")
    ligand = lambda kind: fields(16, {
        4: quoted(F.when(F.col("c_custkey") % 2 == 0, "null").otherwise(F.concat(F.lit("L"), bare(F.col("c_custkey"))))),
        5: quoted(F.concat(F.col("c_name"), F.lit("'s (R)-x, \"y\""))), 6: quoted(F.concat(F.lit("IK"), bare(F.col("c_custkey")))), 9: bare(F.col("c_custkey")),
        12: quoted(F.lit(kind)), 14: quoted(F.lit("C(=O)\\O"))})
    sup = bare(F.col("s_suppkey"))
    polymer = lambda shown: fields(19, {
        4: quoted(homo), 5: quoted(F.concat(F.lit("Q"), sup, F.lit(", P"), sup)), 6: quoted(homo), 8: quoted(shown),
        13: quoted(F.concat(F.lit("P"), sup, F.lit(";null"))), 14: sup})
    parts = [
        statement(o, "pdb_bdb", fields(9, {
            0: quoted(F.concat(F.lit("e"), bare(cust), F.lit(" "))), 1: quoted(F.concat(bare(key), F.lit("; "), bare(key + 1), F.lit(",x"))),
            2: quoted(F.when(key % 2 == 0, key))})),
        statement(o, "cobweb_bdb", measure(price, F.concat(F.lit("<"), bare(price)), homo), where(key % 3 == 0, measure(F.lit(7), F.lit(" 7.0"), homo)),
                  where(key % 5 == 0, measure(price, nobody, nobody)), where(key % 5 == 0, measure(price, nobody, nobody))),
        statement(c, "monomer", ligand("old"), ligand("Small organic molecule")),
        statement(o.filter(key % 11 > 0), "enzyme_reactant_set", fields(20, {
            3: bare(key), 6: bare(cust % 25), 10: quoted(F.lit("inh")), 12: bare(cust), 16: bare(cust % 10), 17: quoted(F.lit("protein_ligand"))})),
        statement(p, "polymer", polymer(F.lit("old")), polymer(F.col("s_name"))),
        statement(n, "entry", fields(10, {
            1: quoted(F.concat(F.col("n_name"), F.lit(" (cited);"))), 2: quoted(F.lit("2026-03-16 00:00:00")), 3: quoted(F.concat(F.lit("Title "), F.col("n_name"))),
            6: bare(F.col("n_nationkey")), 7: quoted(F.lit("Enzyme Inhibition")), 9: quoted(F.concat(F.lit("EZ"), bare(F.col("n_nationkey"))))})),
        statement(n, "unrelated", fields(2, {0: quoted(F.col("n_name"))})),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    whole.write.text(path)


ROWS_SQL = """WITH pairs AS (SELECT 'E' || o_custkey AS entry_id, o_orderkey AS set_id FROM orders UNION SELECT 'E' || o_custkey, o_orderkey + 1 FROM orders),
    m AS (SELECT o_orderkey AS set_id, o_custkey AS monomer_id, CASE WHEN o_orderkey % 2 = 0 THEN 'kinase [A12V]' END AS target_name, 'Homo sapiens' AS source_organism,
        CASE WHEN o_orderkey % 3 = 0 THEN 7.0 ELSE o_totalprice END::DOUBLE AS affinity_nm, CASE WHEN o_orderkey % 3 = 0 THEN '7.0' ELSE '<' || o_totalprice END AS affinity_display FROM orders
      UNION ALL SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'kinase [A12V]' END, NULL, o_totalprice, NULL FROM orders, range(2) WHERE o_orderkey % 5 = 0),
    r AS (SELECT o_orderkey AS set_id, o_custkey % 25 AS article_id, o_custkey % 10 AS polymer_id FROM orders WHERE o_orderkey % 11 > 0),
    j AS (SELECT entry_id, m.*, article_id, polymer_id, CASE WHEN c_custkey % 2 = 0 THEN 'BDBM' || c_custkey WHEN c_custkey IS NOT NULL THEN 'L' || c_custkey END AS ligand_id, c_name || '''s (R)-x, "y"' AS ligand_name,
        CASE WHEN c_custkey IS NOT NULL THEN 'C(=O)\\O' END AS ligand_smiles, 'IK' || c_custkey AS ligand_inchi_key, s_name AS target_display_name, 'P' || s_suppkey || ';null' AS accession_1, 'Q' || s_suppkey || ', P' || s_suppkey AS accession_2,
        'Title ' || n_name AS article_title, n_name || ' (cited);' AS article_comments, 'EZ' || n_nationkey AS ezid
      FROM pairs JOIN m USING (set_id) LEFT JOIN r USING (set_id) LEFT JOIN customer ON c_custkey = monomer_id LEFT JOIN supplier ON s_suppkey = polymer_id LEFT JOIN nation ON n_nationkey = article_id)
    """
COLUMNS = ["entry_id", "set_id", "monomer_id", "affinity_nm", "affinity_display", "target_name", "source_organism", "article_id", "polymer_id", "ligand_id", "ligand_name",
           "ligand_smiles", "ligand_inchi_key", "target_display_name", "accession_1", "accession_2", "article_title", "article_comments", "ezid"]


def joined(spark, sf_dir: str) -> DataFrame:
    root = SC.scratch_path(spark, "dump")
    write_dump(spark, sf_dir, f"{root}/text")
    return DU.dump_rows_of(spark, f"{root}/text", f"{root}/tables")


@query("bulk_dump_rows", "A9", f"{ROWS_SQL} SELECT {', '.join(COLUMNS)} FROM j")
def bulk_dump_rows(spark, sf_dir):
    return joined(spark, sf_dir).select(*COLUMNS)


@query("bulk_dump_samples", "A9 A10",
       ROWS_SQL + """SELECT 'BDB_BULK_' || entry_id || '_' || set_id || '_' || monomer_id || '_Ki' AS sample_id, affinity_nm AS value, CASE WHEN affinity_display LIKE '<%' THEN '<' END AS relation,
         round(log10(affinity_nm), 6) AS log10, CASE WHEN target_name IS NOT NULL THEN 'A12V' END AS mutation, CASE WHEN target_name IS NOT NULL THEN 'mutant' ELSE 'wildtype' END AS state,
         CASE WHEN polymer_id IS NULL OR target_display_name IS NULL THEN '' ELSE 'P' || polymer_id || ';Q' || polymer_id END AS accessions,
         coalesce(target_name, target_display_name) AS target_name, coalesce(source_organism, CASE WHEN target_display_name IS NOT NULL THEN 'Homo sapiens' END) AS organism, article_comments AS reference_text FROM j""")
def bulk_dump_samples(spark, sf_dir):
    return DU.dump_samples(joined(spark, sf_dir)).select(
        "sample_id", "value", "relation", "log10", "mutation", "state", "accessions", "target_name", "organism", "reference_text")
