"""How often the wide joins move their rows, and results where a pair key has several entries."""

import pytest

import __spark_entry__ as entry
from affinityloom.operators import examples as E
from affinityloom.operators import joins as J


@pytest.mark.parametrize("name,most", [("identity_crosswalk", 4), ("training_examples", 4), ("unified_metadata", 9), ("model_ready_gate", 12), ("feature_rows", 14)])
def test_moves(spark, sf_dir, name, most):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= most


def test_crosswalk_of_several_entries(spark):
    pairs = spark.createDataFrame([
        ("p", "E1", ["A", "B"], "L1"), ("p", "E1", ["A", "B"], "L1"), ("p", "E2", ["A"], "L9"), ("q", "E3", [], ""), ("r", "E2", ["X"], "L2"), ("s", "E3", ["A"], None)],
        "pair_key string, entry_id string, receptor array<string>, ligand_key string")
    chains = spark.createDataFrame([("E1", 1, "A", "old"), ("E1", 2, "A", "U1"), ("E1", 3, "B", ""), ("E2", 1, "A", "U2")],
                                   "entry_id string, ord int, chain_id string, accession string")
    ligands = spark.createDataFrame([("E1", 2, "L1", "K2", "x"), ("E1", 1, "L0", None, "L1"), ("E2", 1, "L5", "K5", "y")],
                                    "entry_id string, ord int, component_id string, inchikey string, component_name string")
    got = sorted(map(tuple, J.identity_crosswalk(pairs, chains, ligands).collect()), key=str)
    proteins = "protein:E1:B; protein:U1; protein:U2"
    assert got == sorted([
        ("p", proteins, "ligand:L0", "partial"), ("p", proteins, "ligand:L9", "partial"), ("q", None, None, "unresolved"),
        ("r", "protein:E2:X", "ligand:L2", "partial"), ("s", "protein:E3:A", None, "unresolved")], key=str)


def test_first_assay_and_primary_chain(spark):
    assays = spark.createDataFrame([
        ("p", "k", "E2", 1, ["A"], "L", "s", 1.0), ("p", "k", "E1", 2, ["X", "B"], "L", "s", None), ("p", "k", "E1", 1, ["X", "B"], "L", "t", None), ("q", "k", "E1", 1, ["Y"], "L", "s", None)],
        "pair_key string, kind string, entry_id string, ord int, receptor array<string>, ligand_key string, source string, log_value double")
    chains = spark.createDataFrame([("E1", 2, "B", "late", "o"), ("E1", 1, "B", "U1", "o"), ("E1", 3, "A", "U0", "o"), ("E2", 1, "A", "U2", "o")],
                                   "entry_id string, ord int, chain_id string, accession string, organism string")
    entries = spark.createDataFrame([("E1", "m", 1.0)], "entry_id string, method string, resolution double")
    got = {r["pair_key"]: r for r in E.assemble_examples(assays, entries, chains).collect()}
    assert [(r["entry_id"], r["chain_id"], r["accession"], r["source"], r["label"], r["label_source"]) for r in (got["p"], got["q"])] == [
        ("E1", "B", "U1", "t", 1.0, "group_mean"), ("E1", "A", "U0", "s", None, "none")]


def test_gate_of_own_issues(spark, sf_dir):
    from affinityloom.operators import release as R
    from affinityloom.plans import release as PR
    pairs, issues = PR.release_pairs(spark, sf_dir), PR.entry_issue_frame(spark, sf_dir)
    names = ["entry_id", "pair_key", "kind", "value", "issue_types", "exclusion_reasons"]
    got = R.gate_own_pairs(pairs, issues).select(names).collect()
    expected = R.gate_pairs(pairs, R.pair_issues(pairs).unionByName(issues)).select(names).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len({r["issue_types"] for r in got}) > 3
