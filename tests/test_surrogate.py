"""The joint surrogate against the dense normal equations."""

import numpy as np
import pytest

from affinityloom.operators import surrogate as S
from affinityloom.sources.scans import scratch_path

SCHEMA = "motif_class string, `shell_1.a` double, `geometry.b` double, t1 double, t2 double, note string"


def rows():
    rng = np.random.default_rng(5)
    out = [("mnp"[i % 3], float(rng.normal(i % 3, 2)), float(rng.normal(5, 1)), float(rng.normal()), float(rng.normal(9, 3)), "x") for i in range(200)]
    return [*out, ("m", None, float("nan"), 1.0, None, "x"), ("n", 1.0, 2.0, float("nan"), 3.0, None), (None, 1.0, 1.0, 500.0, 500.0, "x")]


def dense(data):
    number = lambda v: 0.0 if v is None or v != v else v
    data = [r for r in data if r[0] is not None]
    x = np.array([[number(r[2]), number(r[1]), *(float(r[0] == m) for m in "mnp"), 1.0] for r in data])
    y = np.array([[number(r[3]), number(r[4])] for r in data])
    w = np.linalg.solve(x.T @ x + 1e-6 * np.eye(6), x.T @ y)
    return w, ((x @ w - y) ** 2).mean(0)


def test_fit_equals_dense_normal_equations(spark):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(7)
    model = S.fit_surrogate(df, ["shell_1.a", "geometry.b"], ["t1", "t2"])
    w, mse = dense(rows())
    assert model.features == ["geometry.b", "shell_1.a"] and model.motifs == ["m", "n", "p"] and model.rows == 202
    np.testing.assert_allclose(np.vstack([model.weights, model.bases, [model.bias]]), w, rtol=1e-5, atol=1e-6)
    errors = {r["target"]: r["mse"] for r in S.surrogate_errors(model, df.where("motif_class is not null")).collect()}
    np.testing.assert_allclose([errors["t1"], errors["t2"]], mse, rtol=1e-6)


def test_predict_saved_model_with_unseen_motif_and_missing_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    model = S.fit_surrogate(df, ["shell_1.a", "geometry.b"], ["t1", "t2"])
    path = scratch_path(spark, "surrogate")
    model.save(spark, path)
    model.save(spark, path)
    read = S.load_surrogate(spark, path)
    np.testing.assert_array_equal(read.weights, model.weights)
    asked = spark.createDataFrame([(1, "n", 2.0, -7.0), (2, "unseen", 2.0, 0.0), (3, None, None, 0.0)], "id int, motif_class string, `geometry.b` double, t1 double")
    got = {r["id"]: (r["t1"], r["t2"]) for r in read.predict(asked).collect()}
    w, _ = dense(rows())
    np.testing.assert_allclose([got[1], got[2], got[3]], [2 * w[0] + w[3] + w[5], 2 * w[0] + w[5], w[5]], rtol=1e-5, atol=1e-6)


def test_no_rows_no_features_and_constant_features(spark):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        S.fit_surrogate(empty, ["shell_1.a"], ["t1"])
    df = spark.createDataFrame(rows(), SCHEMA)
    bare = S.fit_surrogate(df, [], ["t1"])
    assert bare.weights.shape == (0, 1) and len(bare.motifs) == 3
    constant = S.fit_surrogate(df.selectExpr("*", "3.0D as c", "0.0D as z"), ["c", "z"], ["t1"])
    got = constant.predict(df.where("motif_class is not null").selectExpr("motif_class", "3.0D as c")).groupBy("motif_class").avg("t1").collect()
    want = {r[0]: r[1] for r in df.where("motif_class is not null").selectExpr("motif_class", "coalesce(nanvl(t1, 0D), 0D) as t1").groupBy("motif_class").avg("t1").collect()}
    np.testing.assert_allclose([want[r[0]] for r in got], [r[1] for r in got], rtol=1e-5, atol=1e-6)
