"""Compact sets against plain loops: no pair is ruled out that is similar, no set moves and nothing met is shuffled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinityloom.operators import compact_sets as C
from affinityloom.operators import similarity as J


def random_sets(seed, count=150):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [rng.sample(words, rng.choice([3, 12, 40, 120])) for _ in range(25)]
    return {i: sorted((set(b := rng.choice(bases)) | set(rng.sample(words, rng.randrange(1 + len(b) // 3)))) - set(rng.sample(b, rng.randrange(1 + len(b) // 4))))
            for i in range(count)}


def by_loop(sets, t):
    out = {}
    for a in sets:
        for b in sets:
            if a < b:
                x, y = set(sets[a]), set(sets[b])
                if len(x & y) / len(x | y) >= t:
                    out[a, b] = len(x & y) / len(x | y)
    return out


@pytest.mark.parametrize("seed,t", [(1, 0.3), (2, 0.5), (3, 0.6), (4, 0.9)])
def test_pairs_in_blocks(spark, monkeypatch, seed, t):
    monkeypatch.setattr(C, "HEAD_TOKENS", 300)
    monkeypatch.setattr(C, "MET_AT_ONCE", 50)
    monkeypatch.setattr(C, "PROBES_AT_ONCE", 7)
    monkeypatch.setattr(C, "EXACT_PAIRS", 40)
    sets = random_sets(seed)
    df = spark.createDataFrame(list(sets.items()), "id bigint, tokens array<string>")
    got = {(r["a"], r["b"]): r["similarity"] for r in J.similar_pairs(df, "id", t).collect()}
    assert got == by_loop(sets, t)


def test_text_ids_and_one_size(spark, monkeypatch):
    monkeypatch.setattr(C, "HEAD_TOKENS", 20)
    rng = random.Random(5)
    sets = {f"r{i}": rng.sample("abcdefghij", 4) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id string, tokens array<string>")
    got = {(r["a"], r["b"]): r["similarity"] for r in J.similar_pairs(df, "id", 0.5).collect()}
    assert got == by_loop(sets, 0.5)


def test_sketches_differ_by_no_more_than_sets(spark):
    sets = random_sets(8, 60)
    df = spark.createDataFrame(list(sets.items()), "id bigint, tokens array<string>")
    table = C.compact(C.hashed(df, "id"), "id", 0.5).orderBy("id").toArrow().combine_chunks()
    made = C._arrays(table)
    at = np.array([(i, j) for i in range(60) for j in range(60)])
    least = C._differ(made, at[:, 0], made, at[:, 1])
    assert all(d <= len(set(sets[i]) ^ set(sets[j])) for d, (i, j) in zip(least, at))


def test_leaders_in_blocks(spark, monkeypatch):
    from tests.test_sequential_equivalence import leaders_by_loop
    monkeypatch.setattr(J, "FIRST_BLOCK", 8)
    monkeypatch.setattr(J, "MOST_RECORDS", 32)
    sets = {i: set(s) for i, s in random_sets(11, 90).items()}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id bigint, tokens array<string>")
    assert {r["id"]: r["leader"] for r in J.leader_clusters(df, "id", 0.4).collect()} == leaders_by_loop(sets, 0.4)


def shuffled(spark):
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    return sum(s.shuffleWriteBytes() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None)))


@pytest.mark.parametrize("name", ["similar_set_pairs", "leader_clusters"])
def test_nothing_met_is_shuffled(spark, sf_dir, name):
    """What was met on prefix tokens, and the sets themselves, were shuffled."""
    from affinityloom.plans import similarity as PS
    before = shuffled(spark)
    getattr(PS, name)(spark, sf_dir).count()
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    assert shuffled(spark) - before < texts


def test_kmer_pairs_of_texts(spark, sf_dir):
    from affinityloom.plans import similarity as PS
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    first = {}
    for i in sorted(texts):
        if kmers := frozenset(texts[i][k:k + 8] for k in range(len(texts[i]) - 7)):
            first.setdefault(kmers, i)
    before = shuffled(spark)
    got = {(r["a"], r["b"]): r["similarity"] for r in PS.similar_kmer_pairs(spark, sf_dir).collect()}
    assert shuffled(spark) - before < 4 * sum(map(len, texts.values()))
    expected = by_loop({i: s for s, i in first.items()}, 0.6)
    assert got == {k: round(v, 6) for k, v in expected.items()} and got
