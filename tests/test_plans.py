"""Plan shape: what must not appear in any plan or source file."""

import pathlib
import re

import __spark_entry__ as entry

ROOT = pathlib.Path(__file__).resolve().parents[1] / "affinityloom"


def source():
    return "\n".join(p.read_text() for p in ROOT.rglob("*.py"))


def test_no_cross_join_or_unordered_dedupe():
    text = source()
    assert not re.search(r"\bcrossJoin\(|\blocalCheckpoint\(|\.dropDuplicates\(|\.toPandas\(", text)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_top_rows_limits_before_the_shuffle(spark, sf_dir):
    assert plan(entry.queries()["first_wins_dedupe"](spark, sf_dir)).count("WindowGroupLimit") >= 2


def test_search_filter_reaches_the_scan(spark, sf_dir):
    text = plan(entry.queries()["search_predicate"](spark, sf_dir))
    assert "PushedFilters" in text and "o_totalprice" in text.split("PushedFilters")[1]


def test_no_nested_loop_joins(spark, sf_dir):
    names = ["pair_master", "entry_master", "interface_match", "ligand_any_key_match", "identity_crosswalk", "near_pairs", "query_similarity_join"]
    for name in names:
        text = plan(entry.queries()[name](spark, sf_dir))
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name
