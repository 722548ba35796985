"""Split items: every fallback of identity, family, fold, source and scaffold on hand-made rows."""

from affinityloom.operators.split_items import pair_split_items

ASSAYS = "pair_key string, kind string, entry_id string, source string, selected_source string"
CHAINS = "entry_id string, chain_id string, ord int, sequence string, accession string"
ENTRIES = "entry_id string, ord int, release_date string"
EXAMPLES = "example_id string, pair_key string, kind string, ord int, inchikey string, smiles string, ligand_id string, label_source string, experiment_source string"
METADATA = "pair_key string, entry_id string, ord int, interpro_ids string, pfam_ids string, pathway_ids string, structural_fold string, oligomeric_state string"

LIGAND = "protein_ligand|1ABC|A,B|ATP|A12V"
PROTEIN = "protein_protein|2XYZ|A|C,D|wt"
BARE = "protein_ligand|3QQQ|-|GTP|mutation_unknown:7"


def build(spark, assays, chains=(), entries=(), examples=(), metadata=()):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = pair_split_items(frame(assays, ASSAYS), frame(chains, CHAINS), frame(entries, ENTRIES), frame(examples, EXAMPLES), frame(metadata, METADATA))
    return sorted((r.asDict() for r in out.collect()), key=lambda r: r["item_id"])


def test_keys_of_a_pair_with_everything(spark):
    rows = build(
        spark, [(LIGAND, "Kd", "1ABC", "S", "T")],
        [("1ABC", "A", 1, "MKV", "P2"), ("1ABC", "A", 2, "", "P1"), ("1ABC", "B", 1, "AAA", None)], [("1ABC", 1, "2001-02-03T00:00"), ("1ABC", 2, " ")],
        [("ex1", LIGAND, "Kd", 1, "old", "", "", "", ""), ("ex1", LIGAND, "Kd", 2, " ", "CCO", "L", "", "E"), ("ex2", LIGAND, "Ki", 1, "K", "", "", "", "")],
        [("", "1abc", 1, "IPR1", "", "", "1.10", ""), (LIGAND, "", 2, "", "PF2;PF1, PF2", "R2,R1", "", "dimer")])
    assert [r["item_id"] for r in rows] == ["ex1", "ex1"]
    r = rows[0]
    assert r["receptor_sequence"] == "AAA|MKV" and r["receptor_identity"] == "P1" and r["release_date"] == "2001-02-03"
    assert r["representation_key"] == "protein_ligand|Kd|mutant|has_sequence" and r["hard_group_key"] == "protein_ligand|P1|ATP"
    assert r["scaffold_key"] == "protein_ligand|CCO" and r["source_group_key"] == "protein_ligand|E"
    assert r["family_key"] == r["domain_group_key"] == "protein_ligand|PF2,PF1" and r["pathway_group_key"] == "protein_ligand|R2"
    assert r["fold_group_key"] == "protein_ligand|dimer" and r["mutation_group_key"] == "protein_ligand|PF2,PF1|CCO|a12v"


def test_fallbacks(spark):
    rows = build(spark, [(PROTEIN, None, None, None, " "), (BARE, "", "9ZZZ", "S", None), ("two|parts", "Kd", "1", "S", "S"), ("", "Kd", "1", "S", "S"), (None, "Kd", "1", "S", "S")],
                 [("2XYZ", "A", 1, "MMM", "")], metadata=[(None, "2xyz", 5, " ; ", None, None, "", None), ("", "2XYZ", 9, "IPR9", "", "", "", "")])
    bare, protein = rows
    assert bare["item_id"] == BARE + "|assay_unknown" and bare["receptor_identity"] == "3QQQ:-" and bare["kind"] is None
    assert bare["representation_key"] == "protein_ligand|assay_unknown|unknown|sequence_unknown" and bare["source_group_key"] == "protein_ligand|S"
    assert bare["family_key"] == "protein_ligand|3QQQ:-" and bare["domain_group_key"] == bare["pathway_group_key"] == bare["fold_group_key"] == ""
    assert protein["receptor_identity"] == "MMM" and protein["hard_group_key"] == "protein_protein|MMM|C,D" and protein["scaffold_key"] == "protein_protein|C,D"
    assert protein["representation_key"] == "protein_protein|assay_unknown|wildtype|has_sequence" and protein["source_group_key"] == "protein_protein|source_unknown"
    assert protein["family_key"] == "protein_protein|MMM" and protein["release_date"] is None


def test_repeated_rows_stay_and_empty_tables_give_none(spark):
    assert len(build(spark, [(BARE, "Kd", "9", "S", "S")] * 3)) == 3
    assert build(spark, []) == []


def test_example_named_like_an_item_lends_its_facts(spark):
    rows = build(
        spark, [(LIGAND, "Kd", "1ABC", "S", None), (BARE, None, "3QQQ", "S", None), (BARE, "a|b", "3QQQ", "S", None)],
        examples=[(LIGAND + "|Kd", PROTEIN, "Ki", 2, "KEY", "", "", "Lab", ""), (BARE + "|assay_unknown", PROTEIN, "Ki", 1, "", "CC", "", "", ""), (BARE + "|a|b", PROTEIN, "Ki", 1, "", "NN", "", "", "")])
    found = {r["item_id"]: (r["scaffold_key"], r["source_group_key"]) for r in rows}
    assert found == {LIGAND + "|Kd": ("protein_ligand|KEY", "protein_ligand|Lab"), BARE + "|assay_unknown": ("protein_ligand|CC", "protein_ligand|S"),
                     BARE + "|a|b": ("protein_ligand|NN", "protein_ligand|S")}


def test_entries_that_differ_in_case_keep_their_own_chains_and_days(spark):
    rows = build(spark, [("protein_ligand|1ABC|A,A|X|wt", "Kd", None, "S", None), ("protein_ligand|1abc|A|X|wt", "Kd", None, "S", None)],
                 [("1ABC", "A", 1, "MM", "P1"), ("1abc", "A", 1, "AA", "")], [("1abc", 1, "2002-02-02"), ("1ABC", 1, "2001-01-01")], metadata=[("", "1Abc", 1, "IPR7", "", "", "", "")])
    assert [(r["receptor_sequence"], r["receptor_identity"], r["release_date"], r["domain_group_key"]) for r in rows] == [
        ("MM|MM", "P1", "2001-01-01", "protein_ligand|IPR7"), ("AA", "AA", "2002-02-02", "protein_ligand|IPR7")]


def test_rows_are_moved_twice(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["pair_split_items"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 12
    assert "receptor_identity" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning(" in line)


def test_breakdown_rests_on_the_same_moves(spark, sf_dir):
    import __spark_entry__ as entry

    plan = entry.queries()["split_key_breakdown"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 14
