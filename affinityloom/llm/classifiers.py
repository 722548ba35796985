"""Two text classifiers: scaled character n-grams for toxicity, pairwise ranking for quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.llm.common import _mix, stored

GRAMS = (3, 5, 6, 7, 8, 9)
KEPT_GRAMS = 1 << 15
SMOOTHING = 1.0
#: N-grams of texts that a task holds before it counts and hands them on (8 bytes each).
CHUNK = 1 << 22
#: Partitions of the bounded samples: the fit makes some hundred passes over them.
SAMPLE_PARTS = 8
#: Labelled documents of each label that the toxicity model is fitted on, at most; scores cover all rows.
FIT_ROWS = 4000
#: Places of the table that rules out most n-grams before the search among the kept ones.
SIEVE = 1 << 20


def gram_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the lower-cased text's character n-grams, with repeats; a blank stands at both ends."""
    data = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint64)
    found = [np.empty(0, np.uint64)]
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ data[k:len(data) - n + 1 + k]) * np.uint64(0x100000001B3)
        found.append(_mix(h))
    return np.concatenate(found)


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte: the upper bytes are mostly zero and compress well."""
    return np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def log_count_ratios(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The kept n-grams' hashes, sorted, and their naive Bayes log-count ratios over all rows of (text, label).

    Counts are of documents that hold the n-gram, exact for each 64-bit hash: merged per task in
    chunks, then over tasks by slices of the range of hashes. The ``KEPT_GRAMS`` with the largest
    evidence, |ratio| times the square root of the count, are kept; each slice gives its own best.
    """
    spark = labelled.sparkSession
    bits = max(6, 2 + int(spark.conf.get("spark.sql.shuffle.partitions")).bit_length())
    totals = labelled.agg(F.sum(1 - F.col("label")).alias("n"), F.sum("label").alias("p")).first()
    n, p = float(totals["n"] or 0), float(totals["p"] or 0)

    def counted(hashes: np.ndarray, label: int) -> pa.RecordBatch:
        hashes.sort()
        first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        held, counts = hashes[first], np.diff(first, append=len(hashes)).astype(np.uint32)
        cuts = np.append(np.searchsorted(held, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(held))
        parts = [(k, cuts[k], cuts[k + 1]) for k in range(1 << bits) if cuts[k] < cuts[k + 1]]
        return pa.RecordBatch.from_pydict({
            "slice": pa.array([k for k, _, _ in parts], pa.int32()), "label": pa.array([label] * len(parts), pa.int32()),
            "hashes": pa.array([_packed(held[a:b]) for _, a, b in parts], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for _, a, b in parts], pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # N-grams of label 0 fill the buffer from its start, those of label 1 from its end.
        buffer = np.empty(CHUNK, np.uint64)
        low, high = 0, len(buffer)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = np.unique(gram_hashes((text or "").encode()))
                if len(found) > high - low:
                    yield from (counted(h, k) for k, h in enumerate((buffer[:low], buffer[high:])) if len(h))
                    if len(found) > len(buffer):
                        buffer = np.empty(len(found), np.uint64)
                    low, high = 0, len(buffer)
                if label:
                    high -= len(found)
                    buffer[high:high + len(found)] = found
                else:
                    buffer[low:low + len(found)] = found
                    low += len(found)
        yield from (counted(h, k) for k, h in enumerate((buffer[:low], buffer[high:])) if len(h))

    def best(rows: pa.Table) -> pa.Table:
        hashes = [_unpacked(h) for h in rows.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(c, np.uint32) for c in rows.column("counts").to_pylist()])
        labels = np.repeat(rows.column("label").to_numpy(), [len(h) for h in hashes])
        held, at = np.unique(np.concatenate(hashes), return_inverse=True)
        neg, pos = (np.bincount(at, counts * (labels == k), len(held)) for k in (0, 1))
        often = neg + pos >= 2
        held, neg, pos = held[often], neg[often], pos[often]
        ratio = np.log((pos + SMOOTHING) / (p + 2 * SMOOTHING)) - np.log((neg + SMOOTHING) / (n + 2 * SMOOTHING))
        evidence = np.abs(ratio) * np.sqrt(pos + neg)
        most = np.lexsort((held, -evidence))[:KEPT_GRAMS]
        return pa.table({"hash": held[most].view(np.int64), "ratio": ratio[most], "evidence": evidence[most]})

    per = labelled.select("text", "label").mapInArrow(count, "slice int, label int, hashes binary, counts binary")
    rows = (
        per.groupBy("slice").applyInArrow(best, "hash bigint, ratio double, evidence double")
        .orderBy(F.desc("evidence"), "hash").limit(KEPT_GRAMS).select("hash", "ratio").collect()
    )
    held = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(held)
    return held[order], np.array([r["ratio"] for r in rows], np.float64)[order]


class Grams:
    """Sorted hashes, and a table of their lower bits that most other n-grams fail."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.sieve = np.zeros(SIEVE, bool)
        self.sieve[hashes & np.uint64(SIEVE - 1)] = True

    def places(self, text: bytes) -> np.ndarray:
        """Distinct places, in order, of the hashes that the text holds."""
        found = gram_hashes(text)
        found = np.unique(found[self.sieve[found & np.uint64(SIEVE - 1)]])
        at = np.searchsorted(self.hashes, found)
        inside = at < len(self.hashes)
        at, found = at[inside], found[inside]
        return at[self.hashes[at] == found]


class ToxicityModel:
    """Sorted hashes of the kept n-grams, weight per n-gram (ratio times coefficient) and an intercept."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray, intercept: float):
        self.hashes, self.weights, self.intercept = hashes, weights, intercept

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` plus ``score``; null and empty texts get the score of a text without n-grams. An input ``score`` is replaced."""
        sent = docs.sparkSession.sparkContext.broadcast((self.hashes, self.weights, self.intercept))
        docs = docs.drop("score")
        columns = docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, weights, intercept = sent.value
            grams = Grams(hashes)
            for batch in batches:
                raw = [weights[grams.places((t or "").encode())].sum() + intercept for t in batch.column("text").to_pylist()]
                score = 1 / (1 + np.exp(-np.clip(np.array(raw, np.float64), -500, 500)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score)], [*columns, "score"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(run, f"{fields}, score double")


def _has_both(labelled: DataFrame) -> bool:
    row = labelled.agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    return row["a"] is not None and row["a"] != row["b"]


def fit_toxicity(labelled: DataFrame, reg: float = 1e-2, totals: tuple[int, int] | None = None) -> ToxicityModel:
    """Logistic regression over n-gram presence scaled by log-count ratios, from (text, label).

    Every row given is used; Spark fits on all of them. ``totals`` are the rows of label 0 and 1 that a sample stands
    for: a label's rows weigh as many as they stand for. Rows of label 1 further weigh the root of the labels' ratio, so
    that the rarer label isn't given up at a score of 0.5. Rows with a null label are left out. With labels of one kind
    or none the model gives that rate to every text (0.5 for none).
    """
    labelled = stored(labelled.where(F.col("label").isNotNull()).select("text", F.col("label").cast("int").alias("label")), "labelled")
    if not _has_both(labelled):
        rate = labelled.agg(F.avg("label")).first()[0]
        return ToxicityModel(np.empty(0, np.uint64), np.empty(0), 0.0 if rate is None else (8.0 if rate else -8.0))
    kept, ratios = log_count_ratios(labelled)
    sent = labelled.sparkSession.sparkContext.broadcast((kept, ratios))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, ratios = sent.value
        grams = Grams(kept)
        for batch in batches:
            rows = []
            for t in batch.column("text").to_pylist():
                at = grams.places((t or "").encode())
                rows.append((at.tolist(), ratios[at].tolist()))
            yield pa.RecordBatch.from_pydict({
                "label": batch.column("label"), "at": pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                "value": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})

    size = len(kept)
    to_vector = F.udf(lambda at, value: SparseVector(size, at, value), VectorUDT())
    sparse = stored(labelled.mapInArrow(vectors, "label int, at array<int>, value array<double>"), "features")
    train = sparse.select(F.col("label").cast("double").alias("label"), to_vector("at", "value").alias("features"))
    ones, zeros = (train.where(F.col("label") == k).count() for k in (1, 0))
    all_zeros, all_ones = totals or (zeros, ones)
    # The weights' mean is kept at that of unsampled rows, which the penalty is measured against.
    weight = {1: all_ones / ones * np.sqrt(all_zeros / all_ones), 0: all_zeros / zeros}
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, float(weight[1])).otherwise(float(weight[0])))
    fitted = LogisticRegression(regParam=reg, standardization=False, maxIter=60, weightCol="weight").fit(weighted)
    return ToxicityModel(kept, ratios * fitted.coefficients.toArray(), float(fitted.intercept))


# Quality -----------------------------------------------------------------------------------------

HASHED = 1 << 9
SHAPES = 14
PAIR_SIDE = 6000
PAIRS_PER_DOC = 4


def quality_features(text: bytes) -> np.ndarray:
    """Shape rates of a text, then root frequencies of hashed character pairs."""
    out = np.zeros(SHAPES + HASHED)
    if not text:
        return out
    data = np.frombuffer(text, np.uint8)
    n = len(data)
    upper, lower = ((data >= 65) & (data <= 90)).mean(), ((data >= 97) & (data <= 122)).mean()
    digit, wide = ((data >= 48) & (data <= 57)).mean(), (data >= 128).mean()
    blank = (data <= 32).mean()
    tokens = text.split()
    distinct = len(set(tokens))
    lines = text.split(b"\n")
    stops = np.isin(data, np.frombuffer(b".,;:?'", np.uint8)).mean()
    out[:SHAPES] = (
        1.0, upper, lower, digit, wide, blank, stops, max(0.0, 1 - upper - lower - digit - wide - blank - stops),
        np.log1p(n) / 10, np.log1p(len(tokens)) / 10, distinct / max(len(tokens), 1), np.log1p(n / max(len(tokens), 1)),
        len(set(lines)) / len(lines), np.log1p(distinct / np.sqrt(max(len(tokens), 1))),
    )
    pairs = np.bincount((data[:-1].astype(np.int64) * 2654435761 + data[1:].astype(np.int64) * 40503 >> 5) % HASHED, minlength=HASHED)
    out[SHAPES:] = np.sqrt(pairs / max(n - 1, 1))
    return out


class QualityModel:
    def __init__(self, weights: np.ndarray, threshold: float):
        self.weights, self.threshold = weights, threshold

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` plus ``raw`` (the Bradley-Terry score) and ``score``: logistic of raw less the threshold; inputs so named are replaced."""
        sent = docs.sparkSession.sparkContext.broadcast((self.weights, self.threshold))
        docs = docs.drop("raw", "score")
        columns = docs.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, threshold = sent.value
            for batch in batches:
                raw = np.array([quality_features((t or "").encode()) @ weights for t in batch.column("text").to_pylist()], np.float64)
                score = 1 / (1 + np.exp(-np.clip(raw - threshold, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), pa.array(raw), pa.array(score)], [*columns, "raw", "score"])

        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(run, f"{fields}, raw double, score double")


def preference_pairs(labelled: DataFrame, per_doc: int = PAIRS_PER_DOC) -> DataFrame:
    """(better, worse): feature arrays of a bounded sample's documents of each label, in pairs.

    Each document of label 1 meets ``per_doc`` documents of label 0, at shifted places in the order of the texts' hashes.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [quality_features((t or "").encode()).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "h": batch.column("h"), "x": pa.array(rows, pa.list_(pa.float64()))})

    made = labelled.select("text", "label", F.xxhash64("doc_id", "text").alias("h")).mapInArrow(features, "label int, h bigint, x array<double>")
    made = stored(made, "side").selectExpr("label", "x", "row_number() over (partition by label order by h, x) - 1 as k")
    sides = [made.where(F.col("label") == label).drop("label") for label in (1, 0)]
    n = min(s.count() for s in sides)
    good = sides[0].select(F.col("x").alias("better"), F.explode(F.sequence(F.lit(0), F.lit(per_doc - 1))).alias("s"), "k")
    good = good.withColumn("at", F.pmod(F.col("k") + F.col("s") * 7919, F.lit(max(n, 1))))
    return good.join(sides[1].select(F.col("x").alias("worse"), F.col("k").alias("at")), "at").select("better", "worse")


def score_quantile(model: QualityModel, docs: DataFrame, known: DataFrame) -> float:
    """The quantile of all labelled documents' scores at the share of label 0; equal scores at it get 0.5, so label 1."""
    raw = model.score(docs.select("doc_id", "text")).select("doc_id", "raw").join(known, "doc_id")
    share = known.agg(F.avg(1 - F.col("label"))).first()[0]
    at = raw.agg(F.percentile_approx("raw", F.lit(float(share)), F.lit(10000))).first()[0]
    return 0.0 if at is None else float(at)


def fit_quality(labelled: DataFrame, reg: float = 1e-4) -> QualityModel:
    """Bradley-Terry weights from pairs of (doc_id, text, label) rows, with the rows' own score quantile as threshold.

    ``score_quantile`` gives a threshold over more rows than were fitted on. Rows with a null label are left out. With
    labels of one kind every text gets that label's side (score near 0 or 1), without labels 0.5.
    """
    labelled = stored(labelled.where(F.col("label").isNotNull()).select("doc_id", "text", F.col("label").cast("int").alias("label")), "labelled")
    if not _has_both(labelled):
        only = labelled.agg(F.max("label")).first()[0]
        return QualityModel(np.zeros(SHAPES + HASHED), 0.0 if only is None else (-8.0 if only else 8.0))
    pairs = preference_pairs(labelled)
    sign = F.when(F.xxhash64("better", "worse") % 2 == 0, 1.0).otherwise(-1.0)
    signed = stored(pairs.withColumn("sign", sign).select(
        ((F.col("sign") + 1) / 2).alias("label"),
        F.expr("transform(zip_with(better, worse, (a, b) -> a - b), d -> d * sign)").alias("d")).coalesce(SAMPLE_PARTS), "pairs")
    train = signed.select("label", array_to_vector("d").alias("features"))
    fitted = LogisticRegression(regParam=reg, fitIntercept=False, standardization=True, maxIter=100).fit(train)
    model = QualityModel(fitted.coefficients.toArray(), 0.0)
    return QualityModel(model.weights, score_quantile(model, labelled, labelled.select("doc_id", "label")))


def known_labels(labels: DataFrame, label: str, training) -> DataFrame:
    """(doc_id, label) of the training rows; repeated or clashing labels of an id give its greatest."""
    return labels.where(F.col(label).isNotNull() & training).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, training, per_label: int) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, text, label) of at most ``per_label`` different texts of each label, and how many rows each label has.

    The texts of least hash are taken. Only ids and hashes meet the labels; the texts of the chosen ids, a bounded number,
    are fetched by a broadcast of those.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h")).join(known_labels(labels, label, training), "doc_id")
    rows = stored(hashed.groupBy("label", "h").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "labelled_ids")
    held = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    chosen = [rows.where(F.col("label") == k).orderBy("h").limit(per_label).select("doc_id", "h", "label") for k in (0, 1)]
    picked = stored(chosen[0].unionByName(chosen[1]), "chosen")
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(picked), ["doc_id", "h"])
    # An id that occurs twice with one text is taken once.
    texts = found.groupBy("doc_id", "label", "h").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
    return stored(texts.coalesce(SAMPLE_PARTS), "sample"), (held.get(0, 0), held.get(1, 0))


def digest(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
