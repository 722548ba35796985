"""Joint linear surrogate of site physics: one fit for all targets, a stored model and a prediction step."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RIDGE = 1e-6
#: Motif classes a model may hold; their sums are all that reaches the driver beside the features' matrix.
MAX_MOTIFS = 100_000


@dataclass
class Surrogate:
    """Weights per (feature, target), motif bases per (motif, target) and the bias every motif shares."""

    features: list[str]
    motifs: list[str]
    targets: list[str]
    weights: np.ndarray
    bases: np.ndarray
    bias: np.ndarray
    rows: int

    def predict(self, sites: DataFrame, motif: str = "motif_class") -> DataFrame:
        """``sites`` plus one column per target.

        Missing features (null, NaN, or no such column) count as 0; a motif that the fit hasn't seen, or null, adds
        nothing to the bias. Columns of ``sites`` named like a target are replaced. Bases meet the rows by a broadcast
        of at most ``MAX_MOTIFS`` rows.
        """
        spark = sites.sparkSession
        sites = sites.drop(*self.targets)
        names = [f"__base_{t}" for t in range(len(self.targets))]
        held = spark.createDataFrame(
            [(m, *map(float, b)) for m, b in zip(self.motifs, self.bases)],
            "__motif string" + "".join(f", {n} double" for n in names))
        joined = sites.join(F.broadcast(held), F.col(motif) == F.col("__motif"), "left")
        out = []
        for t, target in enumerate(self.targets):
            value = F.lit(float(self.bias[t])) + F.coalesce(names[t], F.lit(0.0))
            for f, feature in enumerate(self.features):
                if feature in sites.columns:
                    value = value + F.lit(float(self.weights[f, t])) * _number(feature)
            out.append(value.alias(target))
        return joined.select(*(F.col(f"`{c}`") for c in sites.columns), *out)

    def terms(self, spark: SparkSession) -> DataFrame:
        """(kind, position, name, target_position, target, weight), one row per weight."""
        rows = []
        for t, target in enumerate(self.targets):
            rows.append(("bias", 0, "", t, target, float(self.bias[t])))
            rows += [("feature", i, n, t, target, float(self.weights[i, t])) for i, n in enumerate(self.features)]
            rows += [("motif", i, n, t, target, float(self.bases[i, t])) for i, n in enumerate(self.motifs)]
        return spark.createDataFrame(
            rows, "kind string, position int, name string, target_position int, target string, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the terms as Parquet; a model already there is replaced."""
        self.terms(spark).withColumn("rows", F.lit(self.rows).cast("long")).coalesce(1).write.mode("overwrite").parquet(path)


def load_surrogate(spark: SparkSession, path: str) -> Surrogate:
    """The model that ``save`` wrote."""
    found = spark.read.parquet(path).collect()
    targets = [n for _, n in sorted({(r["target_position"], r["target"]) for r in found})]
    named = {k: [n for _, n in sorted({(r["position"], r["name"]) for r in found if r["kind"] == k})] for k in ("feature", "motif")}
    held = {k: np.zeros((n, len(targets))) for k, n in (("feature", len(named["feature"])), ("motif", len(named["motif"])), ("bias", 1))}
    for r in found:
        held[r["kind"]][r["position"], r["target_position"]] = r["weight"]
    return Surrogate(named["feature"], named["motif"], targets, held["feature"], held["motif"], held["bias"][0], found[0]["rows"])


def _number(name: str):
    return F.coalesce(F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(0.0)), F.lit(0.0))


def _row(names: Sequence[str]):
    return F.array(*map(_number, names)).cast("array<double>")


def cross_sums(rows: DataFrame, features: Sequence[str], targets: Sequence[str], motif: str) -> DataFrame:
    """(feature, motif, n, sums): one row per feature with its products with all features and targets, one per motif with
    the sums of all features and targets.

    Each task multiplies its batches as whole matrices and hands on one block; blocks are summed as vectors with map-side
    partial sums, so what is shuffled depends on the number of features, motifs and tasks and not on the rows.
    """
    wide = rows.select(F.col(motif).alias("motif"), _row(features).alias("x"), _row(targets).alias("y"))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, per_motif = np.zeros((len(features), len(features) + len(targets))), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(features))
            both = np.hstack([x, batch.column("y").flatten().to_numpy().reshape(batch.num_rows, len(targets))])
            products += x.T @ both
            coded = batch.column("motif").dictionary_encode()
            at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            order = np.argsort(at, kind="stable")
            sums = np.add.reduceat(both[order], np.searchsorted(at[order], np.arange(len(names))), axis=0)
            for name, total, n in zip(names, sums, np.bincount(at)):
                old = per_motif.get(name, (0.0, 0))
                per_motif[name] = (old[0] + total, old[1] + int(n))
        if per_motif:
            yield pa.RecordBatch.from_pydict({
                "feature": pa.array([*range(len(features)), *[-1] * len(per_motif)], pa.int32()),
                "motif": pa.array([*[""] * len(features), *per_motif], pa.string()),
                "n": pa.array([*[0] * len(features), *(n for _, n in per_motif.values())], pa.int64()),
                "sums": pa.array([*products.tolist(), *(s.tolist() for s, _ in per_motif.values())], pa.list_(pa.float64()))})

    blocks = wide.where(F.col("motif").isNotNull()).mapInArrow(block, "feature int, motif string, n bigint, sums array<double>")
    summed = blocks.groupBy("feature", "motif").agg(F.sum("n").alias("n"), Summarizer.sum(array_to_vector("sums")).alias("sums"))
    return summed.select("feature", "motif", "n", vector_to_array("sums").alias("sums"))


def fit_surrogate(rows: DataFrame, features: Sequence[str], targets: Sequence[str], motif: str = "motif_class") -> Surrogate:
    """Least squares of all targets at once on the features, a 0/1 column per motif class and a constant, with a small ridge.

    Null and NaN features and targets count as 0; rows without a motif are left out; features are taken in name order.
    Motif columns are eliminated first: a motif's base follows from its means, so only the features' own matrix is
    solved. The constant and the motif columns depend on each other; of all equal fits the one of least norm is taken,
    as the ridge does. Without rows there is no model: ValueError.
    """
    features, targets = sorted(features), list(targets)
    sums = cross_sums(rows, features, targets, motif)
    found = sums.limit(len(features) + MAX_MOTIFS + 1).collect()
    held = sorted((r for r in found if r["feature"] < 0), key=lambda r: r["motif"])
    if not held:
        raise ValueError("no training rows with a motif class")
    if len(held) > MAX_MOTIFS:
        raise ValueError(f"more than {MAX_MOTIFS} motif classes")
    k = len(features)
    n = np.array([r["n"] for r in held], float)
    totals = np.array([r["sums"] for r in held])
    products = np.array([r["sums"] for r in sorted((r for r in found if r["feature"] >= 0), key=lambda r: r["feature"])]).reshape(k, k + len(targets))
    within = products - (totals[:, :k] / (n + RIDGE)[:, None]).T @ totals
    gram = within[:, :k] + RIDGE * np.eye(k)
    scale = 1 / np.sqrt(np.maximum(np.diag(gram), RIDGE))
    weights = scale[:, None] * np.linalg.lstsq(gram * np.outer(scale, scale), scale[:, None] * within[:, k:], rcond=1e-13)[0] if k else np.zeros((0, len(targets)))
    bases = (totals[:, k:] - totals[:, :k] @ weights) / (n + RIDGE)[:, None]
    bias = bases.sum(0) / (len(held) + 1)
    return Surrogate(features, [r["motif"] for r in held], targets, weights, bases - bias, bias, int(n.sum()))


def surrogate_errors(model: Surrogate, rows: DataFrame, motif: str = "motif_class") -> DataFrame:
    """(target, mse, n): the mean squared error per target over ``rows``, missing targets counted as 0."""
    actual = {t: f"__actual_{i}" for i, t in enumerate(model.targets)}
    kept = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in actual), *(_number(t).alias(a) for t, a in actual.items()))
    squares = [F.avg(F.pow(F.col(f"`{t}`") - F.col(a), 2)).alias(a) for t, a in actual.items()]
    means = model.predict(kept, motif).agg(F.count(F.lit(1)).alias("n"), *squares)
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.col(a).alias("mse")) for t, a in actual.items()])
    return means.select(F.explode(pairs).alias("p"), "n").select("p.target", "p.mse", "n")
