import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinityloom.llm import classifiers


@pytest.fixture
def labelled(spark, frame):
    docs = frame([(i, f"text {i % 40}") for i in range(200)] + [(500, None), (501, ""), (7, "text 7")])
    labels = spark.createDataFrame([(i, int(i % 40 >= 30), 1) for i in range(200)] + [(500, 1, 1), (501, 0, 1), (7, 1, 1), (999, 1, 1)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_sample_is_bounded_and_counts_all_rows(labelled):
    docs, labels = labelled
    rows, totals = classifiers.labelled_sample(docs, labels, "toxic", F.lit(True), 6)
    got = rows.collect()
    assert totals == (150, 53)  # id 7 stands twice and its greater label counts
    assert [sum(r["label"] == k for r in got) for k in (0, 1)] == [6, 6]
    assert len({(r["text"], r["label"]) for r in got}) == 12
    every, _ = classifiers.labelled_sample(docs, labels, "toxic", F.lit(True), 1000)
    assert {(r["text"], r["label"]) for r in every.collect()} == {(f"text {k}", int(k >= 30)) for k in range(40)} | {("text 7", 1), (None, 1), ("", 0)}


def test_sample_of_nothing(labelled, frame):
    _, labels = labelled
    rows, totals = classifiers.labelled_sample(frame([]), labels, "toxic", F.lit(True), 6)
    assert rows.collect() == [] and totals == (0, 0)


@pytest.mark.parametrize("label,side", [(0, False), (1, True)])
def test_labels_of_one_kind(spark, frame, label, side):
    rows = spark.createDataFrame([(1, "a", label), (2, "b", label), (3, "c", None)], "doc_id long, text string, label int")
    docs = frame([(1, None), (2, "some text")]).select("doc_id", "text")
    for model in (classifiers.fit_toxicity(rows), classifiers.fit_quality(rows)):
        assert {r["score"] >= 0.5 for r in model.score(docs).collect()} == {side}


def test_fit_equals_a_plain_fit(spark):
    """Ratios, weights and scores against Newton's steps on the same loss."""
    texts = [("good morning all", 0), ("good evening all", 0), ("fine day today", 0), ("you awful fool", 1), ("awful awful fool", 1), ("good day", 0)] * 2
    model = classifiers.fit_toxicity(spark.createDataFrame(texts, "text string, label int"), reg=0.05)
    grams = {t: set(classifiers.gram_hashes(t.encode()).tolist()) for t, _ in texts}
    held = sorted({g for t, _ in texts for g in grams[t]})
    n = [sum(y == k for _, y in texts) for k in (0, 1)]
    c = {g: [sum(y == k and g in grams[t] for t, y in texts) for k in (0, 1)] for g in held}
    kept = [g for g in held if sum(c[g]) >= 2]
    assert sorted(model.hashes.tolist()) == kept
    ratio = np.array([math.log((c[g][1] + 1) / (n[1] + 2)) - math.log((c[g][0] + 1) / (n[0] + 2)) for g in kept])
    x = np.array([[r if g in grams[t] else 0.0 for g, r in zip(kept, ratio)] for t, _ in texts])
    y = np.array([v for _, v in texts], float)
    weight = np.where(y == 1, math.sqrt(n[0] / n[1]), 1.0)
    x1, beta = np.column_stack([x, np.ones(len(y))]), np.zeros(len(kept) + 1)
    penalty = np.append(np.full(len(kept), 0.05), 0.0)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ beta))
        slope = x1.T @ (weight * (p - y)) / weight.sum() + penalty * beta
        curve = (x1 * (weight * p * (1 - p) / weight.sum())[:, None]).T @ x1 + np.diag(penalty)
        beta -= np.linalg.solve(curve, slope)
    w, b = beta[:-1], beta[-1]
    docs = spark.createDataFrame([("awful day", 1.5), ("good fool", None), (None, 0.0)], "text string, score double")
    got = [r["score"] for r in model.score(docs).collect()]
    want = []
    for t in ("awful day", "good fool", ""):
        mine = set(classifiers.gram_hashes(t.encode()).tolist())
        want.append(1 / (1 + math.exp(-(sum(v * r for g, v, r in zip(kept, w, ratio) if g in mine) + b))))
    assert got == pytest.approx(want, abs=0.02)
