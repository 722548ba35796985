"""Source queries: scans, sinks and normalisers on lines and files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinityloom.plans import domain as D
from affinityloom.plans.registry import SQL, query, table
from affinityloom.plans.scalars import pick, sql_pick
from affinityloom.sources import annotations as AN
from affinityloom.sources import assays as AS
from affinityloom.sources import scans as SC
from affinityloom.sources import structures as ST


def s(c):
    return F.col(c).cast("string")


@query("json_directory_scan", "A1", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_partkey // 200 % 5 <> 3")
def json_directory_scan(spark, sf_dir):
    """Files of 200 records each (keys are dense); every fifth file is cut short and must be skipped."""
    path = SC.scratch_path(spark, "json")
    n = F.floor(F.col("p_partkey") / 200)
    files = table(spark, sf_dir, "part").groupBy(n.alias("n")).agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_brand", "p_size"))).alias("value"))
    cut = F.when(F.col("n") % 5 == 3, F.substring("value", 1, 50)).otherwise(F.col("value"))
    files.select(cut.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    schema = T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_brand", T.StringType()), T.StructField("p_size", T.IntegerType())])
    rows = SC.read_json_directory(spark, path, schema, "*.txt").filter("p_size IS NOT NULL")
    return rows.select("p_partkey", "p_brand", "p_size")


@query("parquet_round_trip", "A2", "SELECT l_returnflag, count(*) AS n, max(l_orderkey) AS top FROM lineitem GROUP BY 1")
def parquet_round_trip(spark, sf_dir):
    path = SC.scratch_path(spark, "parquet")
    table(spark, sf_dir, "lineitem").write.parquet(path)
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.max("l_orderkey").alias("top"))


@query("csv_sink_and_scan", "A3 A4",
       """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS closed,
         o_orderstatus || '; ' || o_orderpriority AS tags, '{"a":"' || o_orderstatus || '","b":"x, y"}' AS attrs FROM orders""")
def csv_sink_and_scan(spark, sf_dir):
    path = SC.scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus") == "F").alias("closed"),
        F.array("o_orderstatus", F.lit(""), "o_orderpriority").alias("tags"),
        F.create_map(F.lit("b"), F.lit("x, y"), F.lit("a"), F.col("o_orderstatus")).alias("attrs"))
    SC.write_csv(rows, path, ["id", "closed", "tags", "attrs"])
    return SC.read_csv_strings(spark, path, ["id", "closed", "tags", "attrs"])


@query("mutation_table_rows", "A5 G6",
       """SELECT 'P' || event_id AS entry_id, 'A' || user_id || 'V' AS mutation, round(1.987e-3 * 298.15 * ln(value / k), 6) AS ddg FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
       WHERE event_id % 5 > 0 AND event_id % 7 > 0 AND value > 0 AND k > 0 UNION ALL SELECT 'P' || event_id, 'A' || user_id || 'V', NULL FROM events WHERE event_id % 5 > 0 AND event_id % 7 > 0 AND NOT (value > 0 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0)""")
def mutation_table_rows(spark, sf_dir):
    return AS.mutation_rows(mutation_table(spark, sf_dir)).select("entry_id", "mutation", "ddg")


def mutation_table(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("p"), s("event_id"), F.lit("_A_B"))).alias("#Pdb"),
        F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.concat(F.lit("A"), s("user_id"), F.lit("V"))).alias("Mutation(s)_cleaned"),
        s("value").alias("affinity_mut (M)"), F.concat(F.lit(">"), F.get_json_object("props", "$.k")).alias("affinity_wt (M)"), F.lit("298.15").alias("Temperature"))


@query("affinity_index_lines", "A6 G4",
       f"""SELECT 'E' || o_orderkey AS entry_id, round(o_totalprice / 100000.0, 2)::DOUBLE AS resolution, CAST(1990 + o_orderkey % 30 AS INT) AS release_year, {sql_pick(['Kd', 'Ki', 'IC50'], 'o_orderkey')} AS kind,
         {sql_pick(['=', '<', '>='], 'o_custkey')} AS relation, (o_custkey % 900 + 0.5)::DOUBLE AS value, {sql_pick(['nM', 'uM', 'pM'], 'o_custkey')} AS unit,
         round((o_custkey % 900 + 0.5)::DOUBLE * {sql_pick(['1', '1000', '0.001'], 'o_custkey')}::DOUBLE, 6) AS standardized, 'ref ' || o_orderkey AS reference FROM orders WHERE o_orderkey % 11 > 0 AND o_orderkey % 13 > 0""")
def affinity_index_lines(spark, sf_dir):
    return AS.index_lines(index_text(spark, sf_dir)).select(
        "entry_id", "resolution", "release_year", "kind", "relation", "value", "unit", "standardized", "reference")


def index_text(spark, sf_dir):
    value = F.concat(pick(["Kd", "Ki", "IC50"], F.col("o_orderkey")), pick(["=", "<", ">="], F.col("o_custkey")),
                     (F.col("o_custkey") % 900 + 0.5).cast("string"), pick(["nM", "uM", "pM"], F.col("o_custkey")))
    line = F.concat(F.when(F.col("o_orderkey") % 11 == 0, "# ").otherwise(""), F.lit("e"), s("o_orderkey"), F.lit("  "),
                    F.format_string("%.2f", F.col("o_totalprice") / 100000.0), F.lit(" "), (1990 + F.col("o_orderkey") % 30).cast("string"), F.lit(" 7.3 "),
                    F.when(F.col("o_orderkey") % 13 > 0, value).otherwise("none"), F.lit(" // ref "), s("o_orderkey"))
    return table(spark, sf_dir, "orders").select(line.alias("value"))


@query("binding_site_rows", "A7 G4 G5",
       f"""WITH t AS (SELECT *, {sql_pick(['Kd=', 'EC50: ', 'dG ', 'none '], 'l_linenumber')} AS k, {sql_pick([' nM', ' kcal/mol', ''], 'l_suppkey')} AS u FROM lineitem)
       SELECT 'S' || l_orderkey AS entry_id, l_returnflag AS chain_id, round(l_tax * 10, 2) AS resolution, 'L' || l_partkey AS ligand_id, 'B' AS ligand_chain, 2::INT AS n_residues, 1::INT AS n_catalytic, '3.4.21.' || l_linenumber AS ec_number,
         'p' || l_suppkey AS pubmed_id, CASE WHEN k <> 'none ' THEN regexp_extract(k, '[A-Za-z0-9]+') END AS kind, CASE WHEN k <> 'none ' THEN l_quantity END AS value, CASE WHEN k <> 'none ' AND u <> '' THEN trim(u) END AS unit,
         CASE WHEN k <> 'none ' AND (u = ' nM' OR (u = ' kcal/mol' AND k = 'dG ')) THEN l_quantity END AS standardized FROM t""")
def binding_site_rows(spark, sf_dir):
    lines = site_text(spark, sf_dir)
    return AS.site_lines(lines, header=AS.has_site_header(lines)).select(
        "entry_id", "chain_id", "resolution", "ligand_id", "ligand_chain", F.size("residues").alias("n_residues"),
        F.size("catalytic_residues").alias("n_catalytic"), "ec_number", "pubmed_id", "kind", "value", "unit", "standardized")


def site_text(spark, sf_dir):
    affinity = F.concat(pick(["Kd=", "EC50: ", "dG ", "none "], F.col("l_linenumber")), s("l_quantity"), pick([" nM", " kcal/mol", ""], F.col("l_suppkey")))
    given = F.col("l_partkey") % 2 == 0
    line = F.concat_ws(
        "\t", F.concat(F.lit("s"), s("l_orderkey")), "l_returnflag", F.format_string("%.2f", F.col("l_tax") * 10),
        F.concat(F.lit("TYR"), s("l_linenumber"), F.lit(" ASP34")), F.lit("B"), F.concat(F.lit("L"), s("l_partkey")), F.lit("1"),
        F.when(given, affinity).otherwise(""), F.when(given, "Kd=1 M").otherwise(affinity), F.lit("HIS57"), F.concat(F.lit("3.4.21."), s("l_linenumber")), F.lit(""),
        F.concat(F.lit("p"), s("l_suppkey")))
    return table(spark, sf_dir, "lineitem").select(line.alias("value"))


@query("nested_affinity_rows", "A8",
       f"""SELECT 'E' || event_id AS entry_id, 'M' || event_id AS ligand_id, 'Kd' AS kind, value, '>' AS relation, round(value * 1000, 6) AS standardized FROM events
       UNION ALL SELECT 'E' || event_id, 'M' || event_id, 'Ki', CAST(json_extract_string(props, '$.k') AS DOUBLE), NULL, CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events""")
def nested_affinity_rows(spark, sf_dir):
    return AS.nested_affinities(nested_text(spark, sf_dir), "entry_id", "payload").select("entry_id", "ligand_id", "kind", "value", "relation", "standardized")


def nested_text(spark, sf_dir):
    aff = F.array(F.struct(F.concat(F.lit("> "), s("value")).alias("affinity"), F.lit("uM").alias("affinityUnit"), F.lit("Kd").alias("affinityType")),
                  F.struct(F.get_json_object("props", "$.k").alias("affinity"), F.lit("nM").alias("affinityUnit"), F.lit("Ki").alias("affinityType")))
    mono = F.to_json(F.array(F.struct(F.concat(F.lit("M"), s("event_id")).alias("monomerID"), F.lit("CCO").alias("smiles"), aff.alias("affinities"))))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("E"), s("event_id")).alias("entry_id"), mono.alias("payload"))


@query("sql_dump_rows", "A9 U5",
       """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || '''s (main), "x"' || chr(10) AS name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS nation FROM customer
       UNION ALL SELECT CAST(-c_custkey - 1 AS VARCHAR), 'back\\slash', '' FROM customer""")
def sql_dump_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    quoted = F.concat(F.lit("'"), "c_name", F.lit("\\'s (main), \\\"x\\\"\\n'"))
    nation = F.when(F.col("c_custkey") % 2 == 0, "NULL").otherwise(s("c_nationkey"))
    lines = c.select(F.concat(
        F.lit("INSERT INTO `cust` VALUES ("), s("c_custkey"), F.lit(","), quoted, F.lit(", "), nation, F.lit("),("),
        (-F.col("c_custkey") - 1).cast("string"), F.lit(",'back\\\\slash',);")).alias("value"))
    noise = c.select(F.concat(F.lit("INSERT INTO `other` VALUES ("), s("c_custkey"), F.lit(");")).alias("value"))
    return AS.dump_rows(lines.unionByName(noise), "cust", {"id": 0, "name": 1, "nation": 2})


@query("bulk_row_samples", "A10",
       """SELECT 'BDB_BULK_E' || l_orderkey || '_' || l_suppkey || '_' || l_partkey || '_' || l_returnflag AS sample_id, l_quantity AS value, '<' AS relation, round(log10(l_quantity), 6) AS log10,
         CASE WHEN l_linenumber % 2 = 0 THEN 'A' || l_suppkey || 'V' END AS mutation, CASE WHEN l_linenumber % 2 = 0 THEN 'mutant' ELSE 'wildtype' END AS state, 'U1;U' || l_suppkey AS accessions FROM lineitem WHERE l_suppkey <> 1""")
def bulk_row_samples(spark, sf_dir):
    return line_samples(table(spark, sf_dir, "lineitem").filter("l_suppkey <> 1"))


# Supplier 1 names the accession U1 twice; it is kept once.
@query("bulk_row_samples_all", "A10", SQL["bulk_row_samples"].replace("'U1;U' || l_suppkey AS", "CASE WHEN l_suppkey = 1 THEN 'U1' ELSE 'U1;U' || l_suppkey END AS").replace(" WHERE l_suppkey <> 1", ""))
def bulk_row_samples_all(spark, sf_dir):
    return line_samples(table(spark, sf_dir, "lineitem"))


def line_samples(lines):
    return AS.bulk_samples(bulk_lines(lines)).select("sample_id", "value", "relation", "log10", "mutation", "state", "accessions")


def bulk_lines(lines):
    target = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("kinase [A"), s("l_suppkey"), F.lit("V]"))).otherwise("kinase")
    return lines.select(
        F.concat(F.lit("E"), s("l_orderkey")).alias("entry_id"), F.col("l_suppkey").alias("set_id"), F.col("l_partkey").alias("monomer_id"),
        F.col("l_returnflag").alias("kind"), F.concat(F.lit("<"), s("l_quantity")).alias("affinity_display"), F.col("l_quantity").alias("affinity_nm"),
        target.alias("target_name"), F.lit("U1; null").alias("accession_1"), F.concat(F.lit("U"), s("l_suppkey"), F.lit(",U1")).alias("accession_2"))


@query("activity_samples", "A11",
       f"""SELECT 'CHEMBL_A' || event_id AS sample_id, CASE WHEN event_type = 'view' THEN 'dG' ELSE 'Kd' END AS kind, CASE WHEN event_type = 'view' OR value <= 0 THEN NULL WHEN event_id % 2 = 0 THEN round(log10(round(value * 1000, 6)), 6) ELSE 1.5 END::DOUBLE AS log10,
         CASE WHEN event_id % 3 = 0 THEN 'A12V,K3R' END AS mutation, CASE event_id % 3 WHEN 0 THEN 'mutant' WHEN 1 THEN 'wildtype' END AS state,
         CASE WHEN event_id % 3 = 2 THEN 'protein_ligand|-|-|IK' || user_id || '|mutation_unknown:A' || event_id END AS grouping_override FROM events WHERE event_type <> 'error' AND value > 0""")
def activity_samples(spark, sf_dir):
    return event_samples(table(spark, sf_dir, "events").filter("value > 0"))


# A value that is missing or not above 0 leaves the given 9 - 7.5, as in the reference.
@query("activity_samples_all", "A11", SQL["activity_samples"].replace("event_type = 'view' OR value <= 0 THEN", "event_type = 'view' THEN").replace("WHEN event_id % 2 = 0 THEN round(log10", "WHEN event_id % 2 = 0 AND round(value * 1000, 6) > 0 THEN round(log10").replace(" AND value > 0", ""))
def activity_samples_all(spark, sf_dir):
    return event_samples(table(spark, sf_dir, "events"))


def event_samples(events):
    return AS.activity_samples(activity_rows(events)).select("sample_id", "kind", "log10", "mutation", "state", "grouping_override")


def activity_rows(events):
    n = F.col("event_id")
    return events.select(
        F.concat(F.lit("A"), s("event_id")).alias("activity_id"), F.lit("U1").alias("accession"), F.concat(F.lit("IK"), s("user_id")).alias("inchikey"),
        F.when(F.col("event_type") == "view", "ΔG").when(F.col("event_type") == "error", "Potency").otherwise("Kd").alias("standard_type"),
        s("value").alias("standard_value"), F.when(n % 2 == 0, "uM").otherwise("%").alias("standard_units"), F.lit("7.5").alias("pchembl_value"),
        pick(["K3R and A12V and K3R", "wild-type enzyme", "enzyme"], n).alias("assay_description"), F.lit("").alias("activity_comment"), F.lit("kinase").alias("target_name"))


def raw_entries(spark, sf_dir):
    n = F.col("p_partkey")
    chains = F.filter(F.array(F.lit("A"), F.lit("B"), F.lit("C")), lambda x, i: i <= n % 3)
    protein = F.struct(F.lit("1").alias("entity"), F.lit("polypeptide(L)").alias("type"), F.repeat(F.lit("ACDEFGHIKL"), 5).alias("sequence"), chains.alias("chains"),
                       F.array(F.concat(F.lit("U"), n.cast("string"))).alias("accessions"), F.array((n % 7).cast("int")).alias("taxa"), F.lit("p").alias("description"))
    second = F.struct(F.lit("2").alias("entity"), F.lit("polypeptide(L)").alias("type"), F.when(n % 2 == 0, "ACDEFGH").otherwise(F.repeat(F.lit("W"), 40)).alias("sequence"),
                      F.array(F.lit("D")).alias("chains"), F.array(F.lit("U1")).alias("accessions"), F.array(F.lit(9)).alias("taxa"), F.lit("q").alias("description"))
    ligand = F.struct(F.lit("3").alias("entity"), pick(["ZN", "ATP", "LIG", "GOL"], n).alias("component"), F.lit("x").alias("name"), F.array(F.lit("A")).alias("chains"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("R"), n.cast("string")).alias("rcsb_id"), F.col("p_name").alias("title"), F.when(n % 5 == 0, "Membrane Protein").otherwise("ENZYME").alias("keywords"),
        F.col("p_type").alias("method"), F.array(F.col("p_size") / 10.0).alias("resolution"), F.lit("2000-01-01").alias("released"), F.lit(1).alias("assembly_count"),
        F.lit("x").alias("oligomeric_details"), F.filter(F.array(protein, second), lambda e, i: (i == 0) | (n % 3 > 0)).alias("polymer_entities"), F.array(ligand).alias("nonpolymer_entities"))


def scanned_entries(spark, sf_dir):
    path = SC.scratch_path(spark, "entries")
    raw_entries(spark, sf_dir).write.json(path)
    return ST.read_entries(spark, path)


@query("canonical_samples", "A12 B3",
       """SELECT 'R' || p_partkey AS entry_id, CASE WHEN p_partkey % 4 = 2 THEN 'protein_ligand' WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 1 THEN 'protein_protein' ELSE 'unspecified' END AS task,
         CASE WHEN p_partkey % 4 = 2 THEN 'LIG' END AS ligand_id, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 1 AND p_partkey <> 1 THEN 'U1;U' || p_partkey WHEN p_partkey = 1 THEN 'U1' ELSE 'U' || p_partkey END AS accessions, p_size / 10.0::DOUBLE AS resolution FROM part""")
def canonical_samples(spark, sf_dir):
    return ST.canonical_samples(scanned_entries(spark, sf_dir)).select("entry_id", "task", "ligand_id", F.array_join("accessions", ";").alias("accessions"), "resolution")


@query("entry_table_chains", "B4",
       """SELECT 'R' || p_partkey AS rcsb_id, (['A', 'B', 'C'])[i] AS chain_id, 'protein' AS kind FROM part, (SELECT unnest([1, 2, 3]) AS i) WHERE i <= p_partkey % 3 + 1
       UNION ALL SELECT 'R' || p_partkey, 'D', CASE WHEN p_partkey % 2 = 0 THEN 'peptide' ELSE 'protein' END FROM part WHERE p_partkey % 3 > 0""")
def entry_table_chains(spark, sf_dir):
    return ST.entry_tables(raw_entries(spark, sf_dir))["chains"].select("rcsb_id", "chain_id", "kind")


@query("entry_table_entries", "B4 G10 G11",
       """SELECT 'R' || p_partkey AS rcsb_id, p_type AS method, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 1 THEN 2 ELSE 1 END AS protein_count,
         CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 = 1 THEN 'hetero_complex_2_entities' WHEN p_partkey % 3 = 0 THEN 'monomer' WHEN p_partkey % 3 = 1 THEN 'homodimer' ELSE 'homotrimer' END AS oligomeric_state, p_partkey % 5 = 0 AS membrane FROM part""")
def entry_table_entries(spark, sf_dir):
    return ST.entry_tables(raw_entries(spark, sf_dir))["entry"].select("rcsb_id", "method", "protein_count", "oligomeric_state", "membrane")


@query("entry_table_objects", "B4 G7",
       f"""SELECT 'R' || p_partkey AS rcsb_id, {sql_pick(['metal_ion', 'cofactor', 'small_molecule', 'additive'], 'p_partkey')} AS binder_type, {sql_pick(['structural_ion', 'cofactor', 'primary_ligand', 'artifact'], 'p_partkey')} AS role FROM part""")
def entry_table_objects(spark, sf_dir):
    return ST.entry_tables(raw_entries(spark, sf_dir))["bound_objects"].select("rcsb_id", "binder_type", "role")


@query("entity_supplement", "F6", "SELECT 'E' || o_orderkey AS entry_id, 'meta' AS kind FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'E' || o_orderkey, 'parsed' FROM orders WHERE o_orderkey % 2 = 1")
def entity_supplement(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", D.numbered("E", F.col("o_orderkey")).alias("entry_id"), F.lit("1").alias("entity"))
    meta = o.filter("o_orderkey % 2 = 0").select("entry_id", "entity", F.lit("meta").alias("kind"))
    return ST.supplement(meta, o.select("entry_id", "entity", F.lit("parsed").alias("kind"))).select("entry_id", "kind")


@query("component_descriptors", "A13",
       """SELECT p_partkey, 'K' || p_partkey AS inchikey, CASE WHEN p_partkey % 2 = 0 THEN 'C2' ELSE 'C1' END AS smiles_canonical, CASE WHEN p_partkey % 3 = 0 THEN 'S' WHEN p_partkey % 2 = 0 THEN 'C2' ELSE 'C1' END AS smiles FROM part""")
def component_descriptors(spark, sf_dir):
    n = F.col("p_partkey")
    d = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    ds = F.array(d("SMILES_CANONICAL", F.lit("C1")), d("InChIKey", F.concat(F.lit("K"), n.cast("string"))), d("SMILES_CANONICAL", F.when(n % 2 == 0, "C2")),
                 d("SMILES", F.when(n % 3 == 0, "S")))
    return AN.component_descriptors(table(spark, sf_dir, "part").select("p_partkey", ds.alias("ds")), "p_partkey", "ds")


@query("protein_flat_records", "A14",
       """SELECT 'P' || p_partkey AS accession, 'Protein ' || p_name AS protein_name, 'G' || p_size AS genes, 'Org a b' AS organism, p_size::BIGINT AS taxonomy_id, '1ABC;2XYZ' AS entry_ids, p_brand || ';Zinc' AS keywords, 20::INT AS sequence_length FROM part""")
def protein_flat_records(spark, sf_dir):
    n = s("p_partkey")
    rec = F.concat_ws("\n", F.lit("ID   X Reviewed;"), F.concat(F.lit("AC   p"), n, F.lit("; Q1;")), F.lit("AC   Q9;"), F.concat(F.lit("DE   RecName: Full=Protein "), "p_name", F.lit(";")),
                      F.concat(F.lit("GN   Name=G"), s("p_size"), F.lit("; Synonyms=x;")), F.lit("OS   Org a"), F.lit("OS   b"), F.concat(F.lit("OX   NCBI_TaxID="), s("p_size"), F.lit(";")),
                      F.lit("DR   PDB; 2XYZ; X-ray;"), F.lit("DR   PDB; 1ABC; X-ray;"), F.lit("DR   GO; GO:1; x."), F.concat(F.lit("KW   Zinc; "), "p_brand", F.lit(".")),
                      F.lit("SQ   SEQUENCE   20 AA;"), F.lit("     ACDEFGHIKL"), F.lit("     MNPQR STVWY"), F.lit("//"))
    path = SC.scratch_path(spark, "flat")
    table(spark, sf_dir, "part").select(rec.alias("value")).write.text(path)
    return AN.protein_records(AN.read_flat_records(spark, path)).select(
        "accession", "protein_name", F.array_join("genes", ";").alias("genes"), "organism", "taxonomy_id", F.array_join("entry_ids", ";").alias("entry_ids"),
        F.array_join("keywords", ";").alias("keywords"), "sequence_length")


@query("pathway_rollup", "A15",
       """SELECT l_suppkey, array_to_string(list(DISTINCT printf('w%02d', l_partkey % 30) ORDER BY printf('w%02d', l_partkey % 30)), ';') AS pathways, array_to_string(list_sort(list(DISTINCT l_linestatus)), ';') AS species FROM lineitem GROUP BY 1""")
def pathway_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("accession"), F.format_string("w%02d", F.col("l_partkey") % 30).alias("pathway"), F.lit("n").alias("name"), F.col("l_linestatus").alias("species"))
    return AN.pathway_rollup(rows).select(
        F.col("accession").alias("l_suppkey"), F.array_join(F.transform("pathways", lambda p: p["id"]), ";").alias("pathways"),
        F.array_join("species", ";").alias("species"))


@query("cath_domain_rollup", "A16",
       """WITH b AS (SELECT DISTINCT printf('%04d', p_partkey % 500) AS e, (['A', 'B'])[CAST(p_partkey % 2 AS INT) + 1] AS chain, '1.' || (p_partkey % 5) || '.10.' || (p_size % 3) AS code FROM part)
       SELECT e AS entry_id, array_to_string(list_sort(list(DISTINCT code)), ';') AS domain_ids, array_to_string(list_sort(list(DISTINCT chain)), ';') AS chain_ids FROM b GROUP BY 1""")
def cath_domain_rollup(spark, sf_dir):
    n = F.col("p_partkey")
    # The domain prefix is unique per row, so every boundary line has its own classification line.
    prefix = F.concat(F.format_string("%04d", n % 500), pick(["A", "B"], n), s("p_partkey"))
    p = table(spark, sf_dir, "part")
    listing = p.select(F.concat_ws(" ", F.concat(prefix, F.lit("00")), F.lit("1"), (n % 5).cast("string"), F.lit("10"), (F.col("p_size") % 3).cast("string"), F.lit("9")).alias("value"))
    bounds = p.select(F.concat_ws("  ", prefix, F.lit("D01"), F.lit("F00"), F.lit("1"), pick(["A", "B"], n), F.lit("1 -")).alias("value"))
    rows = AN.cath_boundaries(bounds).join(AN.cath_classes(listing), "instance")
    return AN.domain_rollup(rows).select("entry_id", F.array_join("domain_ids", ";").alias("domain_ids"), F.array_join("chain_ids", ";").alias("chain_ids"))


@query("scop_domain_rollup", "A17",
       """WITH r AS (SELECT 'E' || s_nationkey AS e, 'a.' || (s_suppkey % 4) AS code, unnest(CASE s_suppkey % 3 WHEN 0 THEN ['A', 'B'] WHEN 1 THEN ['A'] ELSE ['-'] END) AS chain FROM supplier)
       SELECT e AS entry_id, array_to_string(list_sort(list(DISTINCT code)), ';') AS domain_ids, array_to_string(list_sort(list(DISTINCT CASE WHEN code IN ('a.0', 'a.2') THEN 'family ' || code ELSE 'fold ' || code END)), ';') AS domain_names, array_to_string(list_sort(list(DISTINCT chain)), ';') AS chain_ids FROM r GROUP BY 1""")
def scop_domain_rollup(spark, sf_dir):
    n = F.col("s_suppkey")
    code = F.concat(F.lit("a."), (n % 4).cast("string"))
    sup = table(spark, sf_dir, "supplier")
    cla = sup.select(F.concat_ws("\t", F.concat(F.lit("d"), s("s_suppkey")), F.concat(F.lit("e"), s("s_nationkey")), pick(["A:1-5,B:", "A:", ","], n), code).alias("value"))
    des = sup.select(n.alias("ord"), F.concat_ws("\t", F.lit("1"), F.lit("cf"), code, F.lit("-"), F.concat(F.lit("fold "), code)).alias("value")).unionByName(
        sup.filter("s_suppkey % 2 = 0").select(n.alias("ord"), F.concat_ws("\t", F.lit("2"), F.lit("fa"), code, F.lit("-"), F.concat(F.lit("family "), code)).alias("value")))
    return AN.domain_rollup(AN.scop_domains(cla), AN.scop_names(des)).select(
        "entry_id", F.array_join("domain_ids", ";").alias("domain_ids"), F.array_join("domain_names", ";").alias("domain_names"), F.array_join("chain_ids", ";").alias("chain_ids"))


@query("domain_mapping_rollup", "A18",
       """SELECT 'E' || p_partkey AS entry_id, 'IPR' || p_size || ';PF' || p_size AS domain_ids, CASE WHEN p_partkey % 2 = 0 THEN 'A;B' ELSE 'A' END AS chain_ids FROM part""")
def domain_mapping_rollup(spark, sf_dir):
    second = F.when(F.col("p_partkey") % 2 == 0, '{"struct_asym_id":"B"}').otherwise('{"chain_id":"A"}')
    raw = F.concat(F.lit('{"IPR'), s("p_size"), F.lit('":{"name":"n1","mappings":[{"chain_id":"A"},'), second, F.lit(']},"PF'), s("p_size"), F.lit('":{"description":"n2","mappings":[{"chain_id":"A"}]}}'))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("e"), s("p_partkey")).alias("entry"), raw.alias("payload"))
    return AN.domain_rollup(AN.domain_mappings(rows, "entry", "payload")).select("entry_id", F.array_join("domain_ids", ";").alias("domain_ids"), F.array_join("chain_ids", ";").alias("chain_ids"))


@query("predicted_structure_members", "A19",
       """SELECT 'P' || page_id AS accession, 'AF-p' || page_id || '-F1-model_v' || (page_id % 4) AS model_entry, 'v' || (page_id % 4) AS version FROM pages WHERE page_id % 5 > 0""")
def predicted_structure_members(spark, sf_dir):
    name = F.concat(F.when(F.col("page_id") % 5 == 0, "XX-").otherwise("dir/AF-"), F.lit("p"), s("page_id"), F.lit("-F1-model_v"), (F.col("page_id") % 4).cast("string"), F.lit(".cif.gz"))
    listing = table(spark, sf_dir, "pages").select(name.alias("member"), F.length("html").alias("size"))
    return AN.predicted_members(listing, "member").select("accession", "model_entry", "version")


@query("sharded_package", "A22 A23", "SELECT count(*) AS records, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents")
def sharded_package(spark, sf_dir):
    path = SC.scratch_path(spark, "shards")
    SC.write_shards(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), path, "doc_id", 300)
    m = SC.shard_manifest(SC.read_shards(spark, path, "doc_id bigint, lang string, text string"), "doc_id")
    return m.agg(F.sum("records").alias("records"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


@query("manifest_upsert", "A24 I3",
       "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def manifest_upsert(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("arrival", F.struct("ts", "event_id"))
    return SC.upsert_manifest(ev.filter("event_id % 2 = 0"), ev.filter("event_id % 2 = 1"), ["user_id", "event_type"], "arrival").select(
        "user_id", "event_type", "event_id", "value")


@query("split_sink", "A25 A30", "SELECT split, count(*) AS n FROM (SELECT (['train', 'val', 'test'])[CAST(doc_id % 3 AS INT) + 1] AS split FROM documents) GROUP BY 1")
def split_sink(spark, sf_dir):
    path = SC.scratch_path(spark, "splits")
    SC.write_splits(table(spark, sf_dir, "documents").select("doc_id", pick(["train", "val", "test"], F.col("doc_id")).alias("split")), path, "split")
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("record_health", "A28 U3",
       """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'empty' WHEN 1 THEN 'corrupt' ELSE CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 20 THEN 'valid' ELSE 'invalid' END END AS state FROM events)
       SELECT state, count(*) AS records, array_to_string((list(printf('%06d', event_id) ORDER BY event_id))[1:10], ',') AS examples FROM r GROUP BY 1""")
def record_health(spark, sf_dir):
    n = F.col("event_id") % 6
    rows = table(spark, sf_dir, "events").select(
        F.format_string("%06d", F.col("event_id")).alias("name"), F.when(n == 0, "").when(n == 1, F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("raw"))
    return SC.record_health(rows, "name", "raw", F.get_json_object("raw", "$.k").cast("int") > 20)


@query("assay_source_union", "A29 F1", "SELECT 'a' AS source, count(*) AS n, max(event_id) AS top FROM events WHERE event_type = 'view' UNION ALL SELECT 'b', count(*), max(event_id) FROM events WHERE event_type = 'click'")
def assay_source_union(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    u = SC.union_sources({"a": ev.filter("event_type = 'view'").select("event_id"), "b": ev.filter("event_type = 'click'").select("event_id", "value")})
    return u.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("top"))


@query("pending_structure_inputs", "I2", "SELECT p_partkey FROM part WHERE NOT (p_partkey % 3 = 0 AND p_size % 2 = 0)")
def pending_structure_inputs(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("size"), F.lit("r8").alias("params"))
    done = p.filter("p_partkey % 3 = 0").withColumn("size", F.col("size") - F.col("size") % 2)
    return SC.pending_inputs(p, done, ["p_partkey", "size", "params"]).select("p_partkey")


def coordinate_lines(spark, sf_dir):
    """PDB-style and loop-style coordinate lines of the embedding points."""
    at = lambda i: F.col("embedding")[i].cast("double") * 20
    n = F.col("vec_id")
    e = table(spark, sf_dir, "embeddings")
    pdb = e.select("label", F.concat(
        F.when(n % 4 == 3, "HETATM").otherwise("ATOM  "), F.lpad((n % 99999).cast("string"), 5, " "), F.lit("  "), F.rpad(pick(["N", "CA", "O", "ZN"], n), 3, " "),
        F.when(n % 10 == 0, "B").otherwise(" "), pick(["ALA", "ASP", "LYS", "HOH"], n), F.lit(" "), pick(["A", "B"], n), F.lpad((F.floor(n / 4) % 9999).cast("string"), 4, " "), F.lit("    "),
        *[F.lpad(F.format_string("%.3f", at(i)), 8, " ") for i in range(3)], F.lpad(F.when(n % 7 == 0, "0.50").otherwise("1.00"), 6, " "), F.lpad(F.format_string("%.2f", 20.0 + n % 17), 6, " "),
        F.lit("          "), F.lpad(pick(["N", "C", "O", "ZN"], n), 2, " ")).alias("value"))
    return e, pdb


ATOM_SQL = f"""a AS (SELECT label, vec_id, {sql_pick(['A', 'B'], 'vec_id')} AS chain, CAST(vec_id // 4 % 9999 AS INT) AS number, {sql_pick(['ALA', 'ASP', 'LYS', 'HOH'], 'vec_id')} AS residue, {sql_pick(['N', 'C', 'O', 'ZN'], 'vec_id')} AS element,
  CAST(printf('%.3f', CAST(embedding[1] AS DOUBLE) * 20) AS DOUBLE) AS x, vec_id % 4 = 3 AS hetero, vec_id % 10 = 0 AS alt, vec_id % 7 = 0 AS part FROM embeddings)"""


@query("pdb_atom_table", "A26", f"WITH {ATOM_SQL} SELECT label, chain, number, residue, element, x, hetero FROM a")
def pdb_atom_table(spark, sf_dir):
    return ST.pdb_atoms(coordinate_lines(spark, sf_dir)[1], "label").select("label", "chain", "number", "residue", "element", "x", "hetero")


@query("coordinate_metadata", "A27", f"WITH {ATOM_SQL} SELECT label, count(*) AS atom_count, count(*) FILTER (residue = 'HOH') AS water_count, bool_or(alt) AS has_alternates, bool_or(part) AS has_partial_occupancy, 0::BIGINT AS instance_count FROM a GROUP BY 1")
def coordinate_metadata(spark, sf_dir):
    return ST.coordinate_metadata(ST.pdb_atoms(coordinate_lines(spark, sf_dir)[1], "label"), "label")


@query("residue_centroids", "A26", f"WITH {ATOM_SQL} SELECT label, chain, number, residue, round(avg(x), 4) AS x FROM a GROUP BY 1, 2, 3, 4")
def residue_centroids(spark, sf_dir):
    c = ST.residue_centroids(ST.pdb_atoms(coordinate_lines(spark, sf_dir)[1], "label"), "label")
    return c.select("label", "chain", "number", "residue", F.round("x", 4).alias("x"))


@query("cif_atom_table", "A26", f"WITH {ATOM_SQL} SELECT label, chain, number, residue, element, x, hetero FROM a")
def cif_atom_table(spark, sf_dir):
    e = coordinate_lines(spark, sf_dir)[0]
    n = F.col("vec_id")
    names = ["group_PDB", "type_symbol", "label_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv"]
    heads = e.select("label").distinct().select("label", F.posexplode(F.array(*[F.lit(f"_atom_site.{x} ") for x in names])).alias("line_no", "value")).withColumn("line_no", F.col("line_no").cast("bigint") + 3)
    xyz = [F.format_string("%.3f", F.col("embedding")[i].cast("double") * 20) for i in range(3)]
    body = e.select("label", (n + 100).alias("line_no"), F.concat_ws(
        "  ", F.when(n % 4 == 3, "HETATM").otherwise("ATOM"), pick(["N", "C", "O", "ZN"], n), pick(["N", '"C5\'"', "O", "ZN"], n), F.lit("."), pick(["ALA", "ASP", "LYS", "HOH"], n),
        pick(["A", "B"], n), (F.floor(n / 4) % 9999).cast("string"), *xyz, F.lit("1.0"), F.lit("20.0")).alias("value"))
    return ST.cif_atoms(heads.unionByName(body), "label", "line_no").select("label", "chain", "number", "residue", "element", "x", "hetero")
