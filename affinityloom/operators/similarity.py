"""Set-similarity joins and leader clustering on token sets, exact and without all-pairs work.

Two sets with Jaccard >= t must share a token among their rarest ``n - ceil(t*n) + 1`` tokens, so
only those prefixes are compared; length bounds, the number of shared prefix tokens and parity sketches
cut candidates further and the full sets verify what is left.
Equal sets are collapsed to one representative first: a group of copies costs one set, not a square.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.functions.hashing import char_ngrams
from affinityloom.operators.compact_sets import HEAD_TOKENS, all_possible_pairs, chosen, compact, exact_pairs, hashed, possible_pairs
from affinityloom.session import pin

SEP = "\u0001"


def kmer_tokens(c: Column | str, k: int = 5) -> Column:
    """Sorted distinct character k-mers; empty below length k."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sort_array(F.array_distinct(char_ngrams(F.coalesce(col, F.lit("")), k)))


def pattern_tokens(c: Column | str, pattern: str) -> Column:
    """Sorted distinct regex tokens."""
    col = F.col(c) if isinstance(c, str) else c
    return F.sort_array(F.array_distinct(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.try_divide(common, F.size(a) + F.size(b) - common)


def collapse_copies(sets: DataFrame, record: str, ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(representatives with tokens, record -> representative map) over records with a non-empty set.

    The representative is the copy with the smallest ordinal, found by digests of the sets. Only ids and digests are
    materialised: the sets take several times the room of their texts and are read from their source again.
    """
    names = list(dict.fromkeys([record, ordinal]))
    keyed = pin(sets.filter(F.size("tokens") > 0).select(*names, F.sha2(F.array_join("tokens", SEP), 256).alias("_sig")))
    best = keyed.groupBy("_sig").agg(F.min(F.struct(F.col(ordinal).alias("o"), F.col(record).alias("r"))).alias("_b"))
    best = pin(best.select("_sig", F.col("_b.r").alias("representative")))
    mapping = keyed.join(best, "_sig").drop("_sig")
    # no filter here: it would need the tokens of every record, also where few are asked for
    return chosen(sets, best.select(F.col("representative").alias(record)), record), mapping


def prefixes(sets: DataFrame, record: str, threshold: float, frequency: DataFrame | None = None) -> DataFrame:
    """(token, record, size, rest): the rarest tokens of each set that any partner must share.

    ``rest`` is how many tokens lie outside the prefix. ``frequency`` (token, df) orders tokens;
    given when two tables must agree on one order.
    """
    flat = sets.select(record, F.explode("tokens").alias("token"))
    if frequency is None:
        frequency = token_frequency(sets)
    ranked = flat.join(frequency, "token").groupBy(record).agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("_t"))
    n = F.size("_t")
    keep = F.greatest(n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int") + 1, F.lit(1))
    return ranked.select(record, n.alias("size"), (n - keep).alias("rest"), F.explode(F.slice("_t", 1, keep)).alias("_e")).select(
        F.col("_e.token").alias("token"), record, "size", "rest")


def token_frequency(*frames: DataFrame) -> DataFrame:
    flat = None
    for f in frames:
        part = f.select(F.explode("tokens").alias("token"))
        flat = part if flat is None else flat.unionByName(part)
    return flat.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def _named(post: DataFrame, record: str, name: str) -> DataFrame:
    return post.select("token", F.col(record).alias(name), F.col("size").alias(f"_n_{name}"), F.col("rest").alias(f"_rest_{name}"))


def _candidates(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float, ordered: bool) -> DataFrame:
    """Pairs that can still reach the threshold.

    Beyond the shorter-reaching prefix at most ``rest`` tokens can be shared, so the shared prefix
    tokens must make up the difference to the overlap the threshold asks for.
    """
    t = threshold - 1e-9
    na, nb = F.col(f"_n_{a}"), F.col(f"_n_{b}")
    met = left.join(right, "token").filter((na >= t * nb) & (nb >= t * na))
    if ordered:
        met = met.filter(F.col(a) < F.col(b))
    shared = met.groupBy(a, b, f"_n_{a}", f"_n_{b}", f"_rest_{a}", f"_rest_{b}").agg(F.count(F.lit(1)).alias("_c"))
    needed = F.lit(t / (1.0 + t)) * (na + nb)
    return shared.filter(F.col("_c") + F.greatest(f"_rest_{a}", f"_rest_{b}") >= needed).select(a, b)


def similar_pairs(reps: DataFrame, record: str, threshold: float) -> DataFrame:
    """Pairs (a < b) of representative sets with Jaccard >= threshold.

    Sets are compared inside the tasks, block by block (``compact_sets``): only pairs that their sketches can't rule out
    are written, and those are counted on the whole sets. Tokens are told apart by 64-bit hashes.
    """
    hashes = hashed(reps, record)
    compacted = compact(hashes, record, threshold)
    return exact_pairs(hashes, compacted, all_possible_pairs(compacted, record, threshold), record, threshold)


def similarity_join(queries: DataFrame, targets: DataFrame, query: str, target: str, threshold: float) -> DataFrame:
    """(query, target, similarity) with Jaccard >= threshold between two tables of token sets."""
    frequency = token_frequency(queries, targets)
    q = _named(prefixes(queries, query, threshold, frequency), query, query)
    t = _named(prefixes(targets, target, threshold, frequency), target, target)
    found = _candidates(q, t, query, target, threshold, ordered=False)
    one = queries.select(query, F.col("tokens").alias("_ta"))
    two = targets.select(target, F.col("tokens").alias("_tb"))
    return found.join(one, query).join(two, target).withColumn(
        "similarity", jaccard(F.col("_ta"), F.col("_tb"))).filter(F.col("similarity") >= threshold).drop("_ta", "_tb")


#: Matches that a task holds before it drops those that can't be among the best.
MATCHES_AT_ONCE = 1 << 20


def all_matches(queries: DataFrame, targets: DataFrame, query: str, target: str, block: int = 4096, carry: Sequence[str] = (),
                best: tuple[int, str] | None = None) -> DataFrame:
    """(query, target, similarity) of every pair of sets with a common token, without a threshold.

    Queries are sent to the tasks in blocks of ``block`` sets, so neither side is shuffled; each target
    counts its common tokens with all queries of a block at once. Query ids are taken as they are; equal
    ids are different sets. ``carry`` names columns of the targets that matches keep, so that no match is moved to
    look them up. ``best`` is a number k and a carried column: for a caller that wants the k most similar targets
    (ties: the smallest) of each query and value of that column, a task leaves out those that k others of its batch beat.
    """
    found: DataFrame | None = None
    rows = queries.select(query, "tokens").filter(F.size("tokens") > 0).toLocalIterator()
    kind = queries.schema[query].dataType
    fields = f"`{query}` {kind.simpleString()}, `{target}` {targets.schema[target].dataType.simpleString()}, similarity double"
    fields = ", ".join([fields, *(f"`{c}` {targets.schema[c].dataType.simpleString()}" for c in carry)])
    while held := [r for _, r in zip(range(block), rows)]:
        part = targets.select(target, "tokens", *carry).mapInArrow(
            _common_counts(targets, [tuple(r) for r in held], query, target, carry, best), fields)
        found = part if found is None else found.unionByName(part)
    return targets.sparkSession.createDataFrame([], fields) if found is None else found


def _common_counts(targets: DataFrame, held: list[tuple], query: str, target: str, carry: Sequence[str], best: tuple[int, str] | None):
    places: dict[str, list[int]] = {}
    for i, (_, tokens) in enumerate(held):
        for t in tokens:
            places.setdefault(t, []).append(i)
    sizes = np.array([len(tokens) for _, tokens in held], np.int64)
    sent = targets.sparkSession.sparkContext.broadcast(
        ([q for q, _ in held], sizes, {t: np.array(at, np.int64) for t, at in places.items()}))

    def matches(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, sizes, places = sent.value
        for k, tokens in enumerate(batch.column("tokens").to_pylist()):
            lists = [places[t] for t in tokens or () if t in places]
            if lists:
                common = np.bincount(np.concatenate(lists), minlength=len(sizes))
                at = np.flatnonzero(common)
                yield at, np.full(len(at), k), common[at] / (sizes[at] + len(tokens) - common[at])

    def leading(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Those of a batch's matches that fewer than k of their query and value beat."""
        place = np.empty(batch.num_rows, np.int64)
        place[pc.sort_indices(batch.column(target), null_placement="at_start").to_numpy()] = np.arange(batch.num_rows)
        value = batch.column(best[1]).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        kept, size = [], 0
        for found in matches(batch):
            kept.append(found)
            size += len(found[0])
            if size >= MATCHES_AT_ONCE:
                kept = [_first_of_groups(kept, value, place, best[0])]
                size = 0
        if kept:
            yield _first_of_groups(kept, value, place, best[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pa.array(sent.value[0])
        for batch in batches:
            for at, owner, similarity in (leading if best else matches)(batch):
                taken = [batch.column(c).take(pa.array(owner)) for c in (target, *carry)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), taken[0], pa.array(similarity), *taken[1:]], [query, target, "similarity", *carry])

    return run


def _first_of_groups(found: list[tuple], value: np.ndarray, place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` matches of most similarity (ties: the first target by ``place``) of each query and value of the targets."""
    at, owner, similarity = (np.concatenate(c) for c in zip(*found))
    group = at * (int(value.max(initial=0)) + 1) + value[owner]
    order = np.lexsort((place[owner], -similarity, group))
    group = group[order]
    begins = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else order
    rank = np.arange(len(group)) - np.repeat(begins, np.diff(begins, append=len(group)))
    order = order[rank < k]
    return at[order], owner[order], similarity[order]


#: Records of the first block of leader clustering, and of any.
FIRST_BLOCK = 1 << 10
MOST_RECORDS = 1 << 15


def leader_clusters(sets: DataFrame, record: str, threshold: float = 0.30) -> DataFrame:
    """Leader of every record: in record order, an unassigned record leads and takes every later
    unassigned record with Jaccard >= threshold. Records without tokens lead themselves.

    Equal to the sequential pass, block by block:

    1. copies collapse to their first record;
    2. the first undecided records make a block, which meets itself and all later records inside the tasks;
    3. among the block a record leads once no earlier undecided neighbour remains;
    4. undecided records join their smallest earlier similar leader of the block and are decided, too.

    Blocks double in size up to a bound, so few members of a large group are in the block that meets it first, and the
    rest of the group leaves with them. All edges of a block are written: one that is mostly near copies of each other
    has as many as their square.
    """
    reps, mapping = collapse_copies(sets, record, record)
    hashes = hashed(reps, record)
    compacted = compact(hashes, record, threshold)
    undecided = compacted.select(record, "kept")
    lead_of: DataFrame | None = None
    size = FIRST_BLOCK
    while first := undecided.orderBy(record).limit(size).collect():
        size = min(2 * size, MOST_RECORDS)
        room = np.cumsum([r["kept"] for r in first])
        first = [r[record] for r in first[:max(int(np.searchsorted(room, HEAD_TOKENS, "right")), 1)]]
        heads = sets.sparkSession.createDataFrame([(r,) for r in first], compacted.select(record).schema)
        later = compacted.filter(F.col(record) >= first[0]).withColumn("own", F.lit(True))
        near = possible_pairs(compacted.join(F.broadcast(heads), record, "left_semi"), later, record, threshold)
        if lead_of is not None:
            near = pin(near.join(undecided.select(F.col(record).alias("b")), "b", "left_semi"))
        edges = exact_pairs(hashes, compacted, near, record, threshold)
        inside = edges.join(F.broadcast(heads.withColumnRenamed(record, "b")), "b", "left_semi")
        leaders = _edge_rounds(inside, heads, record)
        taken = edges.join(leaders.select(F.col(record).alias("a")), "a", "left_semi").groupBy("b").agg(F.min("a").alias("leader"))
        found = pin(taken.withColumnRenamed("b", "representative").unionByName(
            leaders.select(F.col(record).alias("representative"), F.col(record).alias("leader"))))
        lead_of = found if lead_of is None else lead_of.unionByName(found)
        undecided = pin(undecided.join(found.select(F.col("representative").alias(record)), record, "left_anti"))
    if lead_of is None:
        return sets.select(record, F.col(record).alias("leader"))
    with_tokens = mapping.join(lead_of, "representative").select(record, "leader")
    alone = sets.filter(F.size("tokens") <= 0).select(record, F.col(record).alias("leader"))
    return with_tokens.unionByName(alone)


def _edge_rounds(edges: DataFrame, undecided: DataFrame, record: str) -> DataFrame:
    """Leaders among ``undecided`` by rounds over similarity edges (a < b)."""
    live = pin(edges.select("a", "b"))
    open_ = undecided
    leaders: DataFrame | None = None
    while True:
        new = pin(open_.join(live.select(F.col("b").alias(record)), record, "left_anti"))
        leaders = new if leaders is None else leaders.unionByName(new)
        members = live.join(new.select(F.col(record).alias("a")), "a", "left_semi").select(F.col("b").alias(record)).distinct()
        gone = new.unionByName(members)
        open_ = pin(open_.join(gone, record, "left_anti"))
        if open_.isEmpty():
            return leaders
        live = pin(live.join(gone.select(F.col(record).alias("a")), "a", "left_anti").join(
            gone.select(F.col(record).alias("b")), "b", "left_anti"))
