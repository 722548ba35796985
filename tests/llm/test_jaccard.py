import random

import pytest

from affinityloom.llm import jaccard_join

from . import brute


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def near():
    """Groups of near copies: chains, stars and many small edits of one text."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    pairs = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        pairs.append((1000 - i, " ".join(w)))
    for i in range(25):
        pairs.append((i, " ".join(base[i:i + 60])))
    return [*pairs, (2000, None), (2001, ""), (2002, "a b"), (2003, "A  b"), (2004, "a")]


@pytest.mark.parametrize("which", ["rows", "odd", "near"])
def test_groups(frame, request, which):
    pairs = request.getfixturevalue(which)
    assert by_id(jaccard_join.jaccard_digest(frame(pairs))) == brute.jaccard(pairs)


def test_pipeline_threshold(frame, near):
    brute_groups = {i: c for i, (_, c) in brute.jaccard(near, 5, 80).items()}
    kept = {r[0] for r in jaccard_join.keep_one_per_group(frame(near)).collect()}
    assert kept == set(brute_groups.values())


def test_long_unlike_texts_are_ruled_out_unread(frame):
    """Of long texts with half their words in common no pair is left for reading; linked ones stay."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    pairs = [(1, " ".join(base)), (2, " ".join(base[:3000] + [f"y{i}" for i in range(3000)])), (3, " ".join(base[:5990]))]
    docs = frame(pairs).selectExpr("doc_id AS id", "text")
    sketches = jaccard_join._signatures(docs, 3, 90).select("id", "n", "sketch", "spread")
    met = docs.sparkSession.createDataFrame([(1, 2), (1, 3), (2, 3)], "a bigint, b bigint")
    assert [(r["a"], r["b"]) for r in jaccard_join._near_by_sketch(met, sketches, 90).collect()] == [(1, 3)]
    assert by_id(jaccard_join.jaccard_digest(frame(pairs))) == brute.jaccard(pairs)


def test_sets_meet_few_pivots(frame, near, monkeypatch):
    """A long prefix doesn't multiply the rows that meet pivots; with hardly any met the exact join finds the same links."""
    met = []
    sketched = jaccard_join._near_by_sketch
    monkeypatch.setattr(jaccard_join, "_near_by_sketch", lambda pairs, *rest: met.append(pairs.count()) or sketched(pairs, *rest))
    whole = by_id(jaccard_join.jaccard_digest(frame(near)))
    assert whole == brute.jaccard(near) and met[0] < 60 * 2 * jaccard_join.PIVOT_SHINGLES
    monkeypatch.setattr(jaccard_join, "PIVOT_SHINGLES", 1)
    assert by_id(jaccard_join.jaccard_digest(frame(near))) == whole
