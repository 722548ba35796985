"""Greedy diversity selection and archetype clustering: exact sequential results in batches.

Both are sequential by definition. Spark scores or assigns every row; only a bounded batch of rows
(a multiple of the target size, or the first undecided rows per motif) ever reaches the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from affinityloom.operators.ordering import top_rows
from affinityloom.session import pin

NOVEL, SPREAD, FRESH = 1.0, 0.45, 0.50
CLUSTER_COST, FAMILY_COST, IDENTITY_COST = 0.55, 0.45, 0.20
#: Undecided vectors that a round of archetype clustering fetches at most, and pairs of vectors compared at a time.
HEAD_ROWS, PAIRS_AT_ONCE = 8192, 1 << 18


def token_weights(pool: DataFrame) -> DataFrame:
    """1/sqrt(frequency) per token; tokens come from a small controlled vocabulary of traits."""
    return pool.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        (1.0 / F.sqrt(F.count(F.lit(1)))).alias("weight"))


def diverse_selection(pool: DataFrame, target: int, cap: int = 1, seed: int = 42, batch_factor: int = 8) -> DataFrame:
    """Greedy selection of ``target`` candidates: (candidate_id, selection_rank).

    ``pool`` has candidate_id (string), base_score, tokens (sorted distinct array), cluster, family
    and identity. Every term of the score can only fall as candidates are taken, so a score computed
    earlier is an upper bound. Each round scores all rows, fetches the best batch, and takes from it
    greedily as long as its best stays at or above the best bound outside; then scores are refreshed.
    """
    weighted = pool.select("candidate_id", F.explode("tokens").alias("token")).join(token_weights(pool), "token").groupBy(
        "candidate_id").agg(F.sort_array(F.collect_list(F.struct("token", "weight"))).alias("traits"))
    rows = pin(pool.drop("tokens").join(weighted, "candidate_id", "left").withColumn(
        "tie", F.md5(F.concat(F.lit(f"{seed}:"), "candidate_id"))))
    covered: Counter[str] = Counter()
    clusters: Counter[str] = Counter()
    families: set[str] = set()
    identities: Counter[str] = Counter()
    chosen: list[str] = []
    relaxed = False
    batch = max(batch_factor * target, 64)
    while len(chosen) < target:
        open_rows = _eligible(rows, clusters, families, cap, relaxed)
        scored = open_rows.withColumn("score", _score_column(covered, clusters, identities))
        head = scored.orderBy(F.col("score").desc(), F.col("tie").desc()).limit(batch + 1).collect()
        if not head:
            if relaxed:
                break
            relaxed = True
            continue
        bound = (head[batch]["score"], head[batch]["tie"]) if len(head) > batch else None
        live = head[:batch]
        progressed = False
        while live and len(chosen) < target:
            usable = [r for r in live if r["family"] not in families and (relaxed or clusters[r["cluster"]] < cap)]
            if not usable:
                break
            best = max(usable, key=lambda r: (_score(r, covered, clusters, identities), r["tie"]))
            key = (_score(best, covered, clusters, identities), best["tie"])
            if bound is not None and key < bound and progressed:
                break
            chosen.append(best["candidate_id"])
            covered.update(t["token"] for t in best["traits"] or [])
            clusters[best["cluster"]] += 1
            families.add(best["family"])
            identities[best["identity"]] += 1
            live = [r for r in live if r["candidate_id"] != best["candidate_id"]]
            progressed = True
    spark = pool.sparkSession
    return spark.createDataFrame([(c, i + 1) for i, c in enumerate(chosen)], "candidate_id string, selection_rank int")


def _eligible(rows: DataFrame, clusters: Counter, families: set, cap: int, relaxed: bool) -> DataFrame:
    """Rows whose family is unused and cluster below its cap; both lists are at most ``target`` long."""
    spark = rows.sparkSession
    out = rows
    if families:
        used = spark.createDataFrame([(f,) for f in sorted(families)], "family string")
        out = out.join(F.broadcast(used), "family", "left_anti")
    full = sorted(c for c, n in clusters.items() if n >= cap)
    if full and not relaxed:
        out = out.join(F.broadcast(spark.createDataFrame([(c,) for c in full], "cluster string")), "cluster", "left_anti")
    return out


def _counts(counter: Counter) -> Column:
    pairs = [F.lit(x) for kv in sorted(counter.items()) for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,int>")


def _taken(counter: Counter, column: str) -> Column:
    return F.coalesce(F.try_element_at(_counts(counter), F.col(column)), F.lit(0))


def _score_column(covered: Counter, clusters: Counter, identities: Counter) -> Column:
    seen = _counts(covered)
    gain = F.aggregate(
        F.coalesce("traits", F.array().cast("array<struct<token:string,weight:double>>")), F.lit(0.0),
        lambda s, t: s + t["weight"] * (
            F.when(F.try_element_at(seen, t["token"]).isNull(), NOVEL).otherwise(0.0)
            + SPREAD / (F.coalesce(F.try_element_at(seen, t["token"]), F.lit(0)) + 1.0)),
    )
    in_cluster = _taken(clusters, "cluster")
    return (F.col("base_score") + gain + F.when(in_cluster == 0, FRESH).otherwise(0.0)
            - CLUSTER_COST * in_cluster - IDENTITY_COST * _taken(identities, "identity"))


def _score(row, covered: Counter, clusters: Counter, identities: Counter) -> float:
    gain = 0.0
    for t in row["traits"] or []:
        n = covered[t["token"]]
        gain += t["weight"] * ((NOVEL if n == 0 else 0.0) + SPREAD / (n + 1.0))
    n = clusters[row["cluster"]]
    return (row["base_score"] + gain + (FRESH if n == 0 else 0.0) - CLUSTER_COST * n
            - IDENTITY_COST * identities[row["identity"]])


def selection_exclusions(pool: DataFrame, selected: DataFrame, cap: int) -> DataFrame:
    """Pool rows not selected, with the reason: family used, cluster cap reached, or target limit."""
    picked = pool.join(selected, "candidate_id")
    used = picked.select("family").distinct().withColumn("_f", F.lit(True))
    full = picked.groupBy("cluster").agg((F.count(F.lit(1)) >= cap).alias("_c"))
    rest = pool.join(selected, "candidate_id", "left_anti").join(used, "family", "left").join(full, "cluster", "left")
    return rest.select(
        "candidate_id",
        F.when(F.col("_f"), "redundant_pair_family").when(F.col("_c"), "receptor_cluster_cap_reached")
        .otherwise("target_limit_after_diversity_ranking").alias("reason"))


def archetype_clusters(rows: DataFrame, motif: str, order: str, vector: str, limit: float = 0.15,
                       batch: int = 200) -> DataFrame:
    """Leader clusters per motif: in row order, the first cluster whose fixed first member lies within
    ``limit`` of normalised distance takes the row.

    Equal vectors collapse first. A leader always settles itself, so vectors with NaN and empty
    ones are clusters of their own. Orders are distinct within a motif. Each round fetches the first
    undecided vectors per motif, finds the leaders among them, and lets Spark assign every undecided
    vector to its first leader. A round fetches ``batch`` vectors a motif at first, then twice as many
    as the last, up to HEAD_ROWS in all motifs together: vectors that are all far apart need as many leaders as rows.
    """
    keyed = rows.select(motif, order, F.col(vector).cast("array<double>").alias("_v"))
    open_ = pin(keyed.groupBy(motif, "_v").agg(F.min(order).alias("_o")))
    fields = f"`{motif}` {rows.schema[motif].dataType.simpleString()}, _v array<double>, _o {rows.schema[order].dataType.simpleString()}"
    done: DataFrame | None = None
    count: Counter = Counter()
    while True:
        heads: dict[object, list] = {}
        for r in top_rows(open_, [motif], [F.col("_o")], batch).orderBy(motif, "_o").collect():
            heads.setdefault(r[motif], []).append((r["_o"], r["_v"]))
        if not heads:
            break
        leaders = {}
        for m, head in heads.items():
            mine = _leading([v for _, v in head], limit)
            leaders[m] = [(head[i][0], head[i][1], count[m] + n) for n, i in enumerate(mine)]
            count[m] += len(mine)
        tried = pin(open_.mapInArrow(_assigned(rows.sparkSession, leaders, motif, limit), f"{fields}, cluster_index int, leader {fields.rsplit(' ', 1)[1]}"))
        settled = tried.where("cluster_index IS NOT NULL")
        done = settled if done is None else done.unionByName(settled)
        open_ = tried.where("cluster_index IS NULL").select(motif, "_v", "_o")
        batch = max(batch, min(2 * batch, HEAD_ROWS // len(heads)))
    if done is None:
        return keyed.select(motif, order, F.lit(None).cast("int").alias("cluster_index"), F.col(order).alias("leader"))
    found = done.select(F.col(motif).alias("_m"), F.col("_v").alias("_w"), "cluster_index", "leader")
    return keyed.join(found, F.col(motif).eqNullSafe(F.col("_m")) & F.col("_v").eqNullSafe(F.col("_w"))).select(motif, order, "cluster_index", "leader")


def _near(rows: np.ndarray, others: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, other) of the pairs of vectors, all of one length, within ``limit``.

    Terms are added in the order of the vector, as ``descriptor_distance`` does. They can't be negative, so a
    pair whose sum is past the limit is dropped before the rest of its terms.
    """
    size = rows.shape[1]
    i, j = (x.ravel() for x in np.indices((len(rows), len(others)), np.int32))
    total = np.zeros(len(i))
    for k in range(size):
        x, y = rows[i, k], others[j, k]
        total = total + np.abs(x - y) / np.maximum(np.maximum(np.abs(x), np.abs(y)), 1.0)
        if k % 4 == 3 and len(i):
            left = ~(total / size > limit)
            i, j, total = i[left], j[left], total[left]
    kept = total / size <= limit
    return i[kept], j[kept]


def _near_pairs(rows: list, others: list, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``_near`` of vectors of any lengths, in blocks of a bounded number of pairs; empty ones and unequal lengths are 1.0 apart."""
    by_size: list[dict[int, list[int]]] = []
    for side in (rows, others):
        by_size.append({})
        for place, v in enumerate(side):
            by_size[-1].setdefault(len(v or ()), []).append(place)
    for size, places in by_size[0].items():
        for other_size, other_places in by_size[1].items():
            there, alike = np.array(other_places), size == other_size and size > 0
            if not alike and limit < 1.0:
                continue
            held = np.array([others[p] for p in other_places], float) if alike else None
            step = max(1, PAIRS_AT_ONCE // len(there))
            for part in (np.array(places[a:a + step]) for a in range(0, len(places), step)):
                i, j = _near(np.array([rows[p] for p in part], float), held, limit) if alike else (
                    x.ravel() for x in np.indices((len(part), len(there))))
                yield part[i], there[j]


def _leading(vectors: list, limit: float) -> list[int]:
    """Places of the vectors without an earlier leader within ``limit``."""
    earlier: list[list[int]] = [[] for _ in vectors]
    for i, j in _near_pairs(vectors, vectors, limit):
        for a, b in zip(i[j < i].tolist(), j[j < i].tolist()):
            earlier[a].append(b)
    leads: list[bool] = []
    for mine in earlier:
        leads.append(not any(leads[b] for b in mine))
    return [i for i, own in enumerate(leads) if own]


def _assigned(spark: SparkSession, leaders: dict, motif: str, limit: float):
    """A function over Arrow batches that adds each vector's first leader; there are at most HEAD_ROWS leaders or those of one first batch."""
    sent = spark.sparkContext.broadcast(leaders)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders, vectors = batch.column("_o").to_pylist(), batch.column("_v").to_pylist()
            best: list = [None] * len(orders)
            places: dict[object, list[int]] = {}
            for place, m in enumerate(batch.column(motif).to_pylist()):
                places.setdefault(m, []).append(place)
            for m, mine in places.items():
                heads = sent.value.get(m, [])
                own = {o: n for n, (o, _, _) in enumerate(heads)}
                for place in mine:
                    best[place] = own.get(orders[place])
                for i, j in _near_pairs([vectors[p] for p in mine], [v for _, v, _ in heads], limit):
                    for place, n in zip((mine[x] for x in i.tolist()), j.tolist()):
                        if heads[n][0] < orders[place] and (best[place] is None or n < best[place]):
                            best[place] = n
                for place in mine:
                    best[place] = None if best[place] is None else heads[best[place]]
            columns = [batch.column(c) for c in (motif, "_v", "_o")]
            index = pa.array([None if b is None else b[2] for b in best], pa.int32())
            leader = pa.array([None if b is None else b[0] for b in best], columns[2].type)
            yield pa.RecordBatch.from_arrays([*columns, index, leader], [motif, "_v", "_o", "cluster_index", "leader"])

    return run


def cluster_representatives(members: DataFrame, keys: list[str], archetype: str, site: str) -> DataFrame:
    """Size and representative (smallest archetype id, then site) per cluster."""
    return members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cluster_size"), F.min(F.struct(archetype, site)).alias("_r")).select(
        *keys, "cluster_size", F.col(f"_r.{archetype}").alias("representative_archetype"),
        F.col(f"_r.{site}").alias("representative_site"))


def queue_batches(representatives: DataFrame, motif: str, order: str, k: int = 20) -> DataFrame:
    """First ``k`` representatives per motif in order, as one ordered list per motif (bounded by k)."""
    return top_rows(representatives, [motif], [F.col(order)], k, rank="_n").groupBy(motif).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_n", order))), lambda s: s[order]).alias("archetype_ids"))
