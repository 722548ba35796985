"""Whole-table forms of queries whose SQL text holds a cut."""

from affinityloom.operators import similarity as J
from affinityloom.plans import similarity as PS


def brute(queries, docs):
    out = {}
    for q, a in queries:
        for d, b in docs:
            if set(a) & set(b):
                out[q, d] = len(set(a) & set(b)) / len(set(a) | set(b))
    return out


def test_every_match_above_zero(spark):
    queries = [(1, ["a", "b", "c"]), (2, ["d"]), (3, []), (4, ["x"] + [f"w{i}" for i in range(40)])]
    docs = [(10, ["a"] + [f"u{i}" for i in range(30)]), (11, ["d"]), (12, ["b", "d"]), (13, []), (14, ["x"]), (15, ["q"])]
    q, d = spark.createDataFrame(queries, "q long, tokens array<string>"), spark.createDataFrame(docs, "d long, tokens array<string>")
    for block in (1, 3, 4096):
        got = J.all_matches(q, d, "q", "d", block)
        rows = got.collect()
        assert {(r["q"], r["d"]): r["similarity"] for r in rows} == brute(queries, docs) and len(rows) == 5


def test_best_matches_are_chosen_before_they_move(spark, monkeypatch):
    """The k best per query and value are all there, with ties and nulls, and little else leaves the tasks."""
    import random

    rng = random.Random(3)
    queries = [(i, rng.sample("abcdefgh", 3)) for i in range(6)]
    docs = [(i, rng.sample("abcdefghijkl", rng.randrange(1, 6)), rng.choice(["s", "t", None])) for i in range(400)]
    q = spark.createDataFrame(queries, "q long, tokens array<string>")
    d = spark.createDataFrame(docs, "d long, tokens array<string>, v string").coalesce(1)
    monkeypatch.setattr(J, "MATCHES_AT_ONCE", 50)
    value, groups = {i: v for i, _, v in docs}, {}
    for (a, b), s in brute(queries, [r[:2] for r in docs]).items():
        groups.setdefault((a, value[b]), []).append((-s, b))
    rows = J.all_matches(q, d, "q", "d", 4, carry=["v"], best=(5, "v")).collect()
    got = {}
    for r in rows:
        got.setdefault((r["q"], r["v"]), []).append((-r["similarity"], r["d"]))
    assert {k: sorted(v)[:5] for k, v in got.items()} == {k: sorted(v)[:5] for k, v in groups.items()}
    assert len(rows) <= 6 * 3 * 5


def test_pairs_below_the_cut_are_kept(spark, sf_dir):
    every = PS.query_matches(spark, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", J.pattern_tokens("text", PS.WORDS).alias("tokens"))
    assert every.where("similarity < 0.2").count() > 0
    assert every.where("similarity >= 0.2").count() == J.similarity_join(items, PS.document_sets(spark, sf_dir), "item_id", "doc_id", 0.2).count()


def test_whole_tables_keep_every_row(spark, sf_dir):
    from pyspark.sql import functions as F

    import __spark_entry__ as entry

    def rows(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    plans = entry.queries()
    lines = rows("lineitem").count()
    assert plans["bulk_measurement_join"](spark, sf_dir).count() == lines
    samples = plans["bulk_row_samples_all"](spark, sf_dir)
    assert samples.count() == lines and samples.where("accessions = 'U1'").count() == rows("lineitem").where("l_suppkey = 1").count() > 0
    assert plans["activity_samples_all"](spark, sf_dir).count() == rows("events").where("event_type <> 'error'").count()
    words = plans["distributions"](spark, sf_dir).where("dimension = 'word'").agg(F.sum("n")).first()[0]
    assert words == sum(len([w for w in r[0].replace("\n", " ").split(" ") if w.strip(" ")]) for r in rows("documents").select("text").collect())


def test_clusters_of_whole_vectors(spark, sf_dir):
    import hashlib

    import __spark_entry__ as entry

    vectors = sorted((r["vec_id"], [float(x) for x in r["embedding"]], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    n = len(vectors)
    start = int(hashlib.md5(f"kmeans:42:{n}".encode()).hexdigest()[:8], 16) % n
    cents = [vectors[(start + i) % n][1] for i in range(4)]
    for step in range(12):
        own = [min(range(4), key=lambda k: (sum((a - b) ** 2 for a, b in zip(v, cents[k])), k)) for _, v, _ in vectors]
        if step < 11:
            for k in range(4):
                mine = [v for (_, v, _), o in zip(vectors, own) if o == k]
                cents[k] = [round(sum(c) / len(mine), 9) for c in zip(*mine)] if mine else cents[k]
    got = {r["vec_id"]: r["cluster"] for r in entry.queries()["kmeans_clusters_all"](spark, sf_dir).collect()}
    assert got == {i: o for (i, _, _), o in zip(vectors, own)}
