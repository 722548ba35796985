"""Best targets: pairs of equal token sets are reduced before they meet the queries, with equal results."""

import random

from affinityloom.operators import pair_scores as PS
from tests.test_feature_rows import score_by_loop

PAIRS = "`order` long, tokens array<string>, targets array<string>, base double"


def test_pairs_of_one_token_set_are_reduced_to_those_that_can_lead(spark):
    rows = [(i, ["b", "a"] if i % 2 else ["a", "b"], [f"t{i % 100}"], (i % 50) / 100) for i in range(5000)]
    assert PS._leading_pairs(spark.createDataFrame(rows, PAIRS), 5).count() <= 20


def test_ties_and_copies_equal_a_loop(spark):
    rng = random.Random(4)
    sets = [None, [], ["a"], ["a", "b"], ["b", "c"], ["d"]]
    # Bases that differ by less than a rounding step tie after rounding; then the order decides.
    pairs = [(i, rng.choice(sets), sorted({f"t{rng.randint(0, 30)}" for _ in range(rng.randint(0, 3))}), rng.randint(0, 3) / 20 + rng.randint(0, 2) * 1e-10) for i in range(600)]
    rng.shuffle(pairs)
    queries = [(i, rng.choice(sets)) for i in range(12)]
    got = PS.best_targets(spark.createDataFrame(queries, "query long, tokens array<string>"), spark.createDataFrame(pairs, PAIRS), ["base"], 4)
    assert sorted((r["query"], r["rank"], r["target"]) for r in got.collect()) == [x[:3] for x in score_by_loop(queries, pairs, 4)]
