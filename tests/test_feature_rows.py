"""Feature rows and pair scores on a few rows with known values, and the plan of the assembly."""

import re

import pytest

import __spark_entry__ as entry
from affinityloom.operators import feature_rows as FR
from affinityloom.operators import pair_scores as PS
from affinityloom.plans import features


@pytest.fixture(scope="module")
def made(spark):
    df = spark.createDataFrame
    assays = df([
        ("E1", "protein_ligand|E1|B,A|LIG|wt", "Kd", 2, 5.0), ("E1", "protein_ligand|E1|B,A|LIG|wt", "Kd", 1, 4.0),
        ("E1", "protein_ligand|E1|-|OTHER|wt", "Kd", 3, 1.0), ("E2", "odd key", "Ki", 1, 2.0), ("", "protein_ligand|E1|A|LIG|wt", "Kd", 1, 9.0),
        ("E3", "protein_ligand|E3|Z|LIG|wt", "Kd", 1, 3.0)], "entry_id string, pair_key string, kind string, ord int, value double")
    entries = df([("E1", 2.1), ("E2", 3.0)], "entry_id string, resolution double")
    chains = df([("E1", "A", True, "MKW", 1), ("E1", "B", True, None, 2), ("E1", "C", False, "DD", 3), ("E2", "A", True, "", 1), ("E2", "B", True, "DDD", 2)],
                "entry_id string, chain_id string, is_protein boolean, sequence string, ord int")
    objects = df([("E1", "X", "", "LIG", None, "cofactor", True, 2), ("E1", "LIG", "KEY", "", 300.0, "ion", False, 3), ("E1", "Q", "", "", 90.0, "ion", False, 1)],
                 "entry_id string, component_id string, inchikey string, component_name string, molecular_weight double, component_type string, is_covalent boolean, ord int")
    faces = df([("E1", ["A"], "LIG", "ligand", 4), ("E1", ["A"], "ELSE", "other", 8), ("E1", [], "", "unlisted", 16), ("E1", ["C", "B"], "", "protein", 32),
                ("E2", ["A"], "", "far", 64)], "entry_id string, chains array<string>, partner string, interface_type string, residue_count int")
    nodes = df([("E1", "A", "n1", 2), ("E1", "B", "n1", 3), ("E1", "C", "n2", 1), ("E2", "A", "n3", 1)], "entry_id string, chain_id string, node_id string, ord int")
    degrees = df([("n1", 5, 1, 2, 3), ("n2", 7, 0, 0, 0)], "node_id string, network_degree int, ppi_degree int, pli_degree int, pathway_count int")
    structures = df([("E1", 100)], "entry_id string, atom_count_total int")
    micro = df([("odd key", "Ki", 6)], "pair_key string, kind string, microstate_record_count int")
    physics = df([("odd key", "Ki", -1.5)], "pair_key string, kind string, estimated_net_charge double")
    rows = FR.feature_rows(assays, entries, chains, objects, faces, nodes, degrees, structures, micro, physics).collect()
    return {r["pair_key"].split("|")[-2] + r["entry_id"] if "|" in r["pair_key"] else "odd": r for r in rows}


def test_one_row_per_pair_and_kind(made):
    assert set(made) == {"LIGE1", "OTHERE1", "odd", "LIGE3"} and made["LIGE1"]["value"] == 4.0


def test_listed_chains_and_named_ligand(made):
    r = made["LIGE1"]
    # B comes first but has no sequence; both chains are one node; the first object of that name has no weight.
    assert (r["sequence_length"], r["protein_aromatic_fraction"], r["network_degree"], r["receptor_chain_count"]) == (3, 0.333333, 5, 2)
    assert (r["interface_residue_count"], r["interface_types"]) == (36, ["ligand", "protein"])
    assert (r["ligand_component_type"], r["ligand_is_covalent"], r["ligand_molecular_weight"]) == ("cofactor", True, 90.0)
    assert (r["protein_chain_count"], r["ligand_count"], r["resolution"], r["atom_count_total"], r["microstate_record_count"]) == (2, 3, 2.1, 100, None)


def test_without_listed_chains(made):
    r = made["OTHERE1"]
    assert (r["interface_residue_count"], r["interface_types"], r["network_degree"], r["sequence_length"]) == (48, ["protein", "unlisted"], 7, 3)
    assert (r["ligand_component_type"], r["ligand_molecular_weight"]) == (None, 90.0)


def test_key_of_another_shape_and_unknown_entry(made):
    r = made["odd"]
    assert (r["interface_residue_count"], r["sequence_length"], r["network_degree"], r["microstate_record_count"], r["estimated_net_charge"]) == (64, 3, 0, 6, -1.5)
    r = made["LIGE3"]
    assert (r["interface_residue_count"], r["interface_types"], r["sequence_length"], r["ligand_count"], r["resolution"]) == (0, [], None, 0, None)


def test_assay_payload_is_shuffled_once(spark, sf_dir):
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        plan = features.feature_frame(spark, sf_dir)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # ``source`` is read by nothing but the output, so it stands for the wide row.
    moved = [p for p in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*?)\]", plan) if "source#" in p]
    assert len(moved) == 1
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def score_by_loop(queries, pairs, k):
    out = []
    for q, mine in queries:
        best = {}
        for order, tokens, targets, base in pairs:
            union = set(mine or ()) | set(tokens or ())
            s = len(set(mine or ()) & set(tokens or ())) / len(union) if union else 0.0
            for t in targets:
                best[t] = min(best.get(t, (9, 0)), (-round(0.55 * s + base, 9), order))
        out += [(q, i + 1, t, o) for i, (t, (_, o)) in enumerate(sorted(best.items(), key=lambda x: (x[1], x[0]))[:k])]
    return sorted(out)


@pytest.mark.parametrize("k,block,held", [(25, 512, 200_000), (3, 2, 1)])
def test_best_targets_equal_a_loop(spark, monkeypatch, k, block, held):
    import random
    rng = random.Random(6)
    monkeypatch.setattr(PS, "QUERY_BLOCK", block)
    words = lambda n: [rng.choice("abcdefghij") for _ in range(rng.randint(0, n))]
    queries = [(i, words(5) or None) for i in range(7)]
    pairs = [(i, sorted(set(words(6))), sorted({f"t{rng.randint(0, 8)}" for _ in range(rng.randint(0, 3))}), rng.randint(-3, 6) / 20) for i in range(120)]
    queries = [(i, sorted(set(t)) if t else None) for i, t in queries]
    got = PS.best_targets(spark.createDataFrame(queries, "query long, tokens array<string>"),
                          spark.createDataFrame(pairs, "`order` long, tokens array<string>, targets array<string>, base double"), [], k)
    assert sorted((r["query"], r["rank"], r["target"], r["order"]) for r in got.withColumn("order", got["rank"] * 0).collect()) == [
        (q, r, t, 0) for q, r, t, _ in score_by_loop(queries, pairs, k)]


def test_pair_rows_stay_in_their_tasks(spark, sf_dir):
    plan = entry.queries()["pair_score_targets"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_narrow_keys_meet_lists_of_their_entry(spark, sf_dir):
    plan = features.feature_frame(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # Six lookups with keys of their own took 28 shuffles and a stored table of keys.
    assert plan.count("Exchange hashpartitioning(") <= 16 and "Scan ExistingRDD" not in plan
