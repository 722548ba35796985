"""Small domain cases with known values."""

import pytest
from pyspark.sql import functions as F

from affinityloom.functions import affinity as A
from affinityloom.functions import classify as C
from affinityloom.functions import hashing as H
from affinityloom.functions import keys as K
from affinityloom.functions import quality as Q
from affinityloom.functions import text as T
from affinityloom.operators import graph as G
from affinityloom.operators import measurements as M
from affinityloom.operators import selection as SEL
from affinityloom.operators import spatial as P
from affinityloom.operators import splits as S
from affinityloom.sources import annotations as AN
from affinityloom.sources import assays as AS


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


def summary(spark, rows):
    df = spark.createDataFrame(rows, "k string, t string, source string, lv double")
    return {(r["k"], r["t"]): r for r in M.group_summary(df, ["k", "t"], "source", "lv").collect()}


def test_mean_of_two_measurements(spark):
    r = summary(spark, [("p", "Kd", "PDBbind", 0.69897), ("p", "Kd", "PDBbind", 0.845098)])[("p", "Kd")]
    assert r["measurement_count"] == 2 and r["mean_log10"] == 0.772034 and not r["conflict_flag"]
    assert r["preferred_rationale"] == "single_source:PDBbind"


def test_types_are_not_merged(spark):
    r = summary(spark, [("p", "Kd", "a", 1.0), ("p", "Ki", "a", 2.0)])
    assert {k: v["measurement_count"] for k, v in r.items()} == {("p", "Kd"): 1, ("p", "Ki"): 1}


def test_conflict_between_sources(spark):
    r = summary(spark, [("p", "Kd", "PDBbind", 0.69897), ("p", "Kd", "BindingDB", 2.69897)])[("p", "Kd")]
    assert r["conflict_flag"] and r["agreement_band"] == "low" and r["preferred_source"] == "PDBbind"
    assert r["conflict_summary"] == "high_conflict_spread=2.000"


def test_pair_key_parts(spark):
    p = one(spark, K.parse_pair_key(lit("protein_ligand|1ABC|A|ATP|wt")))
    assert (p["task"], p["entry"], list(p["receptor"]), p["ligand"], p["mutation"]) == ("protein_ligand", "1ABC", ["A"], "ATP", "wt")
    assert one(spark, K.parse_pair_key(lit("protein_ligand|1ABC|A|wt"))) is None
    assert one(spark, K.parse_pair_key(lit("a|b"))) is None


def test_chain_group_key(spark):
    assert one(spark, K.chain_group_key(F.array(lit(" B"), lit("A"), lit("B")))) == "A,B"
    assert one(spark, K.chain_group_key(F.array(lit(" ")))) == ""
    assert one(spark, K.chain_group_key(F.array().cast("array<string>"))) == "-"


def test_affinity_text(spark):
    a = one(spark, A.parse_affinity(lit("<= 5"), lit("uM")))
    assert (a["value"], a["standardized"], a["relation"]) == (5.0, 5000.0, "<=")


def test_ddg(spark):
    assert abs(one(spark, A.ddg(lit("2e-8"), lit("1e-8"), lit("298.15"))) - 0.410637) < 1e-6
    assert one(spark, A.ddg(lit("2e-8"), lit("1e-8"), lit("300.15"), lit("1.75"))) == 1.75
    assert round(one(spark, A.celsius(lit("300.15"))), 6) == 27.0


def test_index_line(spark):
    df = spark.createDataFrame([("1abc 2.00 2020 7.30 Kd=5.0nM // reference text",), ("# note",), ("1x 2",)], "value string")
    rows = AS.index_lines(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["entry_id"], r["resolution"], r["release_year"], r["kind"], r["value"], r["standardized"], r["reference"]) == (
        "1ABC", 2.0, 2020, "Kd", 5.0, 5.0, "reference text")


def test_site_line_with_header(spark):
    head = "PDB_ID\treceptor_chain\tbinding_site_residues\tligand_chain\tligand_ID\tligand_serial\tbinding_affinity\tcatalytic_site_residues\tPubMed_ID"
    df = spark.createDataFrame([(head,), ("1ABC\tA\tTYR15 ASP34\tB\tATP\t401\tKd=5.0 nM\tHIS57\t123456",)], "value string").coalesce(1)
    assert AS.has_site_header(df)
    r = AS.site_lines(df, header=True).collect()
    assert len(r) == 1 and r[0]["residues"] == ["TYR15", "ASP34"] and r[0]["value"] == 5.0


def test_activity_without_context_gets_override(spark):
    cols = "activity_id string, accession string, inchikey string, standard_type string, standard_value string, standard_units string, pchembl_value string, assay_description string, activity_comment string, target_name string"
    df = spark.createDataFrame([("A1", "U", "IK", "Kd", "5", "nM", "", "wild type enzyme", "", ""), ("A2", "U", "IK", "Ki", "15", "nM", "", "enzyme", "", "")], cols)
    rows = {r["sample_id"]: r for r in AS.activity_samples(df).collect()}
    assert rows["CHEMBL_A1"]["state"] == "wildtype" and rows["CHEMBL_A1"]["grouping_override"] is None
    assert rows["CHEMBL_A2"]["grouping_override"].endswith("mutation_unknown:A2")


def test_fold_classification_line(spark):
    df = spark.createDataFrame([("d1abca_\t1abc\tA:\ta.1.1.1\t46456",)], "value string")
    r = AN.scop_domains(df).first()
    assert (r["entry_id"], r["chain_id"], r["domain_id"]) == ("1ABC", "A", "a.1.1.1")


def test_predicted_member(spark):
    df = spark.createDataFrame([("AF-P12345-F1-model_v6.pdb.gz", 10), ("readme.txt", 1)], "member string, size bigint")
    rows = AN.predicted_members(df, "member").collect()
    assert [(r["accession"], r["version"], r["model_entry"]) for r in rows] == [("P12345", "v6", "AF-P12345-F1-model_v6")]


def test_pathway_count(spark):
    nodes = spark.createDataFrame([("p1", "Protein"), ("w1", "Pathway"), ("w2", "Pathway"), ("w3", "Pathway")], "node_id string, node_type string")
    edges = spark.createDataFrame([("p1", "w1", G.PATHWAY), ("w2", "p1", G.PATHWAY), ("p1", "w3", G.PATHWAY), ("p1", "p1", G.PPI)],
                                  "source string, target string, edge_type string")
    r = G.degree_features(nodes, edges).first()
    assert (r["network_degree"], r["ppi_degree"], r["pathway_count"]) == (5, 2, 3)


def test_dated_split(spark):
    df = spark.createDataFrame([("early", "2000-01-01"), ("mid", "2010-01-01"), ("late", "2020-01-01")], "i string, d string")
    got = {r["i"]: r["split"] for r in S.temporal_split(df, "i", "d", 0.34, 0.33).collect()}
    assert got == {"early": "train", "mid": "test", "late": "test"}


@pytest.mark.parametrize("train,val", [(-0.1, 0.2), (0.8, 0.3), (1.2, 0.0)])
def test_bad_fractions(train, val):
    with pytest.raises(ValueError):
        H.check_fractions(train, val)


def test_classification(spark):
    assert one(spark, C.polymer_kind(lit("polypeptide(L)"), lit("A" * 30))) == "peptide"
    assert one(spark, C.polymer_kind(lit("polypeptide(L)"), lit("A" * 31))) == "protein"
    assert one(spark, C.component_kind(lit("zn")))["binder_type"] == "metal_ion"
    assert one(spark, C.oligomeric_state(F.array(F.array(lit("A"), lit("B"))))) == "homodimer"


def test_confidence_penalty(spark):
    assert abs(one(spark, Q.confidence_penalty(lit('{"a":"medium","b":"LOW"}'))) - 0.24) < 1e-9
    assert one(spark, Q.confidence_penalty(lit("not json"))) == 0.2
    assert one(spark, Q.confidence_penalty(lit(""))) == 0.0


def test_ligand_input(spark):
    assert one(spark, T.ligand_input_error(lit("c1ccccc1"))) is None
    assert one(spark, T.ligand_input_error(lit("C(C"))) == "unbalanced"
    assert one(spark, T.ligand_input_error(lit("a\nb"))) == "multi_line"


def test_dump_tuples(spark):
    line = r"INSERT INTO `t` VALUES (1,'it\'s (x), ok',NULL),(2,'a\\b','');"
    df = spark.createDataFrame([(line,), ("INSERT INTO `u` VALUES (9);",)], "value string")
    rows = [tuple(r) for r in AS.dump_rows(df, "t", {"a": 0, "b": 1, "c": 2}).collect()]
    assert rows == [("1", "it's (x), ok", None), ("2", "a\\b", "")]


def test_hash_buckets_beyond_two_digits_stay_apart(spark):
    names = spark.range(3000).select(H.hash_bucket("p", F.col("id").cast("string"), 256).alias("b")).distinct().count()
    assert names == 256


def test_every_species_of_a_pathway_is_kept(spark):
    rows = spark.createDataFrame([("P1", "w1", "n", "Human"), ("P1", "w1", "n", "Mouse"), ("P1", "w2", "n", "Human")],
                                 "accession string, pathway string, name string, species string")
    assert AN.pathway_rollup(rows).first()["species"] == ["Human", "Mouse"]


def test_explicit_ddg_goes_first(spark):
    names = ["#Pdb", "Mutation(s)_cleaned", "affinity_mut (M)", "affinity_wt (M)", "Temperature", "ddG (kcal/mol)"]
    rows = spark.createDataFrame([("1abc_A_B", "AB1C", "1e-8", "1e-9", "298", "1.75"), ("1abc_A_B", "AB2C", "1e-8", "1e-9", "298", "")], names)
    got = {r["mutation"]: r["ddg"] for r in AS.mutation_rows(rows).collect()}
    assert got["AB1C"] == 1.75 and got["AB2C"] > 1


def test_only_the_header_line_is_left_out(spark):
    lines = spark.createDataFrame([("pdb_id\tchain",), ("1PDB\tA",)], "value string")
    assert [r["entry_id"] for r in AS.site_lines(lines, header=True).collect()] == ["1PDB"]


def test_both_spellings_of_smiles(spark):
    one_affinity = '"affinities": [{"affinity": "5", "affinityUnit": "nM"}]'
    payload = f'[{{"Smiles": "CC", {one_affinity}}}, {{"smiles": "CO", {one_affinity}}}]'
    df = spark.createDataFrame([("e", payload)], "entry string, payload string")
    assert sorted(r["smiles"] for r in AS.nested_affinities(df, "entry", "payload").collect()) == ["CC", "CO"]


def test_charges_do_not_leak_between_structures(spark):
    rows = [("s1", "r1", 1, 0.0), ("s1", "r2", -1, 5.0), ("s2", "r1", 1, 0.0), ("s2", "r2", -1, 1.0)]
    residues = spark.createDataFrame(rows, "structure string, residue string, sgn int, x double").selectExpr("*", "0D as y", "0D as z")
    got = P.nearest_charges(residues, residues.where("false"), "structure", "residue", "sgn").collect()
    assert {(r["structure"], r["opposite"]) for r in got} == {("s1", 5.0), ("s2", 1.0)}


def test_vectors_equal_to_nothing_end_the_clustering(spark):
    rows = spark.createDataFrame([("m", 1, [float("nan")]), ("m", 2, []), ("m", 3, [1.0]), ("m", 4, [1.01])], "motif string, ord int, v array<double>")
    got = {r["ord"]: r["leader"] for r in SEL.archetype_clusters(rows, "motif", "ord", "v").collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_site_table_without_header_has_thirteen_columns(spark):
    lines = spark.createDataFrame([("1abc\tA\t2.1\tTYR15,ASP34\tB\tATP\t401\t\tKd=5nM\tHIS57\t2.7.1.1\tGO:1\t77",)], "value string")
    assert not AS.has_site_header(lines)
    r = AS.site_lines(lines, header=False).first()
    assert (r["entry_id"], r["resolution"], r["ligand_id"], r["residues"], r["catalytic_residues"]) == ("1ABC", 2.1, "ATP", ["TYR15", "ASP34"], ["HIS57"])
    assert (r["kind"], r["value"], r["unit"], r["standardized"], r["ec_number"], r["pubmed_id"]) == ("Kd", 5.0, "nM", 5.0, "2.7.1.1", "77")


def test_site_values_are_found_by_the_header_names(spark):
    lines = spark.createDataFrame([("PMID\tPDB\tAffinity\tProtein Chain\tLigand-ID",), ("9\t2xyz\tEC50: <3 uM\tC\tGTP",)], "value string").coalesce(1)
    r = [x for x in AS.site_lines(lines, header=True).collect() if x["entry_id"] != "PDB"][0]
    assert (r["entry_id"], r["chain_id"], r["ligand_id"], r["kind"], r["value"], r["standardized"], r["pubmed_id"]) == ("2XYZ", "C", "GTP", "EC50", 3.0, 3000.0, "9")
    assert AS.site_lines(lines, header=True).count() == 1


def test_free_energy_text(spark):
    got = one(spark, A.parse_site_affinity(F.lit("ΔG = 7.5 kcal/mol")))
    assert (got["kind"], got["value"], got["standardized"]) == ("dG", 7.5, 7.5)
    assert one(spark, A.parse_site_affinity(F.lit("no affinity")))["kind"] is None


def test_every_spelling_of_nested_affinities(spark):
    payload = '[{"monomerID": 7, "affinities": [{"Affinity": "> 5", "AffinityUnit": "nM", "AffinityType": "Kd", "uniprot_primary_id": "P1", "ChainIDs": "A;B", "PMID": "3"},' \
              ' {"value": 2, "Unit": "uM", "affinityType": "Ki", "targetName": "t"}]}, {"cid": "c", "affinities": []}]'
    rows = AS.nested_affinities(spark.createDataFrame([("e", payload), ("f", None)], "entry string, payload string"), "entry", "payload").collect()
    got = {r["kind"]: r for r in rows}
    assert len(rows) == 2 and (got["Kd"]["value"], got["Kd"]["relation"], got["Kd"]["accession"], got["Kd"]["receptor_chains"], got["Kd"]["ligand_id"]) == (5.0, ">", "P1", ["A", "B"], "7")
    assert (got["Ki"]["standardized"], got["Ki"]["target"], got["Ki"]["receptor_chains"]) == (2000.0, "t", None)


def test_site_edges_and_features_stay_in_their_structure(spark):
    refined = spark.createDataFrame([("s1", "x", 1.0, "a"), ("s1", "y", -1.0, "a"), ("s2", "x", 2.0, "a"), ("s2", "y", 2.0, "a")],
                                    "structure string, site string, refined_charge double, motif string")
    edges = spark.createDataFrame([("s1", "x", "y", 2.0), ("s2", "x", "y", 4.0)], "structure string, site_a string, site_b string, distance double")
    got = P.enriched_edges(edges, refined, "structure", "site").collect()
    assert {(r["structure"], r["coulombic"]) for r in got} == {("s1", -0.5), ("s2", 1.0)} and len(got) == 2
    shells = spark.createDataFrame([("s1", "x", "shell_1", 3.0), ("s2", "x", "shell_1", 9.0)], "structure string, site string, shell string, n double")
    wide = P.site_feature_pivot(shells, edges, "structure", "site", ["n"], ["shell_1"]).collect()
    assert {(r["structure"], r["shell_1_n"], r["mean_distance"]) for r in wide} == {("s1", 3.0, 2.0), ("s2", 9.0, 4.0)}
