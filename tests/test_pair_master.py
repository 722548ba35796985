"""The pair master on a few rows with known values, and how often its rows are moved."""

import __spark_entry__ as entry
from affinityloom.operators.joins import pair_master


def test_lists_of_the_entry_are_matched_per_row(spark):
    df = spark.createDataFrame
    assays = df([("E1", "protein_ligand|E1|B,A|LIG|wt", "Kd"), ("E1", "protein_ligand|E1|-|KEY|wt", "Kd"), ("E2", "protein_ligand|E2|Z|LIG|wt", None), ("E1", None, "Kd")],
                "entry_id string, pair_key string, kind string")
    entries = df([("E1", "X-ray")], "entry_id string, method string")
    chains = df([("E1", "A", "U2", "O1"), ("E1", "A", "U2", "O1"), ("E1", "B", " ", "O2"), ("E1", "C", "U9", "O9")], "entry_id string, chain_id string, accession string, organism string")
    objects = df([("E1", "LIG", "KEY", "", "ion"), ("E1", "LIG", "", "LIG", "cofactor"), ("E1", "Q", "", "", "other"), ("E2", "Q", "", "", "ion")],
                 "entry_id string, component_id string, inchikey string, component_name string, component_type string")
    faces = df([("E1", ["A"], "LIG", "p"), ("E1", ["A"], "LIG", "p"), ("E1", ["C"], "", "q"), ("E1", [], None, "r")], "entry_id string, chains array<string>, partner string, interface_type string")
    features = assays.where("kind = 'Kd'")
    splits = df([("protein_ligand|E1|B,A|LIG|wt", "Kd", "train"), ("protein_ligand|E1|B,A|LIG|wt", "Ki", "val"), ("protein_ligand|E2|Z|LIG|wt", None, "test")], "pair_key string, kind string, split string")
    rows = pair_master(assays, entries, chains, objects, faces, features, splits).collect()
    columns = ("method", "accession", "organism", "component_type", "matching_interface_count", "matching_interface_types", "feature_count", "split")
    found = {r["pair_key"]: tuple(r[c] for c in columns) for r in rows}
    assert len(rows) == 4 and found == {
        "protein_ligand|E1|B,A|LIG|wt": ("X-ray", "U2", "O1; O2", "cofactor; ion", 3, "p; r", 1, "train"),
        "protein_ligand|E1|-|KEY|wt": ("X-ray", "", "", "ion", 2, "q; r", 1, ""),
        "protein_ligand|E2|Z|LIG|wt": (None, "", "", "", 0, "", 0, ""), None: ("X-ray", "", "", "", 0, "", 0, "")}


def test_rows_are_moved_twice(spark, sf_dir):
    plan = entry.queries()["pair_master"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 9
