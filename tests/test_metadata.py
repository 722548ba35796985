"""Entry selection and unified metadata on hand-made rows."""

import pytest

from affinityloom.operators import metadata as MD


def ids(df):
    return [r["entry_id"] for r in sorted(df.collect(), key=lambda r: r["position"])]


def test_selection_modes(spark):
    plan = spark.createDataFrame([(3, " 1abc"), (1, "2XYZ"), (2, "1ABC "), (4, None), (5, " ")], "ord int, pdb_id string")
    listing = spark.createDataFrame([(1, None, "9zzz"), (2, "8yyy", "7xxx"), (3, "", "6www")], "ord int, pdb_id string, source_record_id string")
    asked = spark.createDataFrame([(1, "b"), (2, "a"), (3, "B")], "ord int, entry_id string")
    assert ids(MD.select_ids("refresh_plan", refresh_plan=plan)) == ["2XYZ", "1ABC"]
    assert ids(MD.select_ids("training_set", refresh_plan=plan, training_set=listing)) == ["9ZZZ", "8YYY", "6WWW"]
    assert ids(MD.select_ids("preview", refresh_plan=plan, training_set=listing, limit=1)) == ["2XYZ"]
    assert ids(MD.select_ids("preview", training_set=listing)) == ["9ZZZ", "8YYY", "6WWW"]
    assert ids(MD.select_ids("all", explicit=asked, limit=0)) == ["B", "A"]
    assert ids(MD.select_ids("refresh_plan", refresh_plan=plan.limit(0))) == []
    assert MD.select_ids("all", training_set=listing) is None and MD.select_ids("training_set") is None
    with pytest.raises(ValueError):
        MD.select_ids("some")
    many = spark.range(30).selectExpr("id as ord", "concat('e', id) as pdb_id")
    assert len(ids(MD.select_ids("preview", refresh_plan=many))) == MD.PREVIEW


def test_subset_copy(spark):
    rows = spark.createDataFrame([("1abc", 1), ("1ABC", 2), ("x", 3), (None, 4)], "k string, v int")
    chosen = MD.select_ids("all", explicit=spark.createDataFrame([(1, "1Abc")], "ord int, entry_id string"))
    assert sorted(r["v"] for r in MD.copy_subset(rows, chosen, "k").collect()) == [1, 2]
    assert MD.copy_subset(rows, None, "k").count() == 4


def test_unified_metadata_ladders(spark):
    entry = "entry_id string, ord int, organisms string, method string, resolution string, oligomer string"
    entries = spark.createDataFrame([("E1", 1, "old", "NMR", "3", "monomer"), ("E1", 2, "human", "X-RAY", "2", "dimer"), ("E2", 1, None, None, None, None)], entry)
    pair = "entry_id string, ord int, pair_key string, source string, kind string, value double, mean double, receptor_chains string, receptor_accessions string, organisms string, ligand_types string, interface_types string, mutations string"
    assays = spark.createDataFrame([
        ("E1", 1, "k1", None, "Kd", None, 4.5, "B; A, B", None, "", None, None, None), ("E1", 2, "k2", "S", "Kd", 2.0, 1.0, None, "P9;P8", "mouse", "l", "i", "m"),
        ("E2", 3, "k3", None, None, None, None, "Z", None, None, None, None, None), (None, 4, "k4", None, None, None, None, "A", None, None, None, None, None)], pair)
    chains = spark.createDataFrame([("E1", 1, "A", "AAA", "P1"), ("E1", 2, "B", "", "P2"), ("E1", 3, "B", "BBB", "P1"), ("E1", 4, "A", "AAC", "P3")], "entry_id string, ord int, chain_id string, sequence string, accession string")
    proteins = spark.createDataFrame([("P1", "one", ["g"], True, 10), ("P9", None, None, False, None)], "accession string, protein_name string, genes array<string>, reviewed boolean, length int")
    domain = "entry_id string, chain_id string, id string, ord int"
    cath = spark.createDataFrame([("E1", "B", "1.2", 1), ("E1", None, "9.9", 2)], domain)
    scop = spark.createDataFrame([("E1", "", "s.2", 2), ("E1", "", "s.1", 1), ("E1", "", "s.2", 3), ("E1", "C", "s.9", 0)], domain)
    args = MD.pairs_from_assays(assays, entries.where("ord = 2 or entry_id = 'E2'")), entries, chains, proteins
    got = {r["pair_key"]: r for r in MD.unified_metadata(*args, cath, scop).collect()}
    assert sorted(got) == ["k1", "k2", "k3"]
    one, two, three = got["k1"], got["k2"], got["k3"]
    assert (one["sequence"], one["sequence_count"], one["accessions"], one["accession"]) == ("BBB", 3, "P1; P3", "P1")
    assert (one["value"], one["source"], one["organism"], one["method"]) == ("4.5", "RCSB", "human", "X-RAY")
    assert (one["cath_ids"], one["scop_ids"], one["fold"], one["protein_name"], one["reviewed"]) == ("1.2", "s.1; s.2", "1.2", "one", "true")
    assert (two["sequence"], two["accession"], two["organism"], two["cath_ids"], two["reviewed"], two["sequence_length"]) == ("AAC", "P9", "mouse", "9.9", "false", "")
    assert (three["sequence"], three["sequence_count"], three["fold"], three["reviewed"], three["organism"]) == ("", 0, "", "", "")
    none = cath.limit(0)
    assert {r["pair_key"]: r["fold"] for r in MD.unified_metadata(*args, none, scop).collect()}["k1"] == "s.1; s.2"
    assert {r["pair_key"]: r["fold"] for r in MD.unified_metadata(*args, none, none).collect()}["k1"] == "dimer"
