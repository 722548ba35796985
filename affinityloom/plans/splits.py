"""Ordering, sampling and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.functions.hashing import hash_split
from affinityloom.operators import ordering as O
from affinityloom.operators import splits as S
from affinityloom.plans.registry import query, table

HASH_SPLIT_SQL = """CASE WHEN CAST('0x' || substr(md5('42:' || {id}), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.7 THEN 'train'
  WHEN CAST('0x' || substr(md5('42:' || {id}), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END"""


@query("hash_split", "E17", f"SELECT doc_id, {HASH_SPLIT_SQL.format(id='doc_id')} AS split FROM documents")
def hash_split_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hash_split("doc_id").alias("split"))


@query("first_wins_dedupe", "E1",
       """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
         SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_shipdate) AS rn
         FROM lineitem) WHERE rn = 1""")
def first_wins_dedupe(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber",
                                                 "l_extendedprice", "l_shipdate")
    return O.first_rows(li, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate"]
                        ).drop("l_shipdate")


@query("round_robin_sample", "E3",
       """WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS pass_number,
           min(doc_id) OVER (PARTITION BY lang, source) AS group_first FROM documents)
       SELECT doc_id, lang, source, pass_number FROM r ORDER BY pass_number, group_first, doc_id LIMIT 150""")
def round_robin_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return O.round_robin_sample(docs, ["lang", "source"], "doc_id", 150).select(
        "doc_id", "lang", "source", F.col("pass_number").cast("bigint").alias("pass_number"))


@query("limited_sample", "E4",
       """WITH p AS (SELECT doc_id, lang, source FROM documents ORDER BY doc_id LIMIT 300),
       r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pn, min(doc_id) OVER (PARTITION BY lang) AS gf FROM p)
       SELECT doc_id, lang FROM r ORDER BY pn, gf, doc_id LIMIT 30""")
def limited_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return O.limited_sample(docs, ["lang"], "doc_id", 30).select("doc_id", "lang")


@query("consecutive_edges", "E6",
       """SELECT * FROM (SELECT user_id, event_id AS event_id_a, lead(event_id) OVER w AS event_id_b, value AS value_a,
         lead(value) OVER w AS value_b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_id_b IS NOT NULL""")
def consecutive_edges(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return O.consecutive_pairs(ev, ["user_id"], ["ts", "event_id"], ["event_id", "value"])


@query("consecutive_turns", "E6",
       """SELECT * FROM (SELECT conv_id, turn AS turn_a, lead(turn) OVER w AS turn_b, role AS role_a, lead(role) OVER w AS role_b
         FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE turn_b IS NOT NULL""")
def consecutive_turns(spark, sf_dir):
    return O.consecutive_pairs(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["turn", "role"])


@query("cross_validation_folds", "E15",
       "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders")
def cross_validation_folds(spark, sf_dir):
    return O.fold_numbers(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"),
                          ["o_orderdate", "o_orderkey"], 5).select("o_orderkey", "fold")


@query("upper_median_threshold", "E18",
       """SELECT event_type, value AS upper_median FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r,
         count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r = n // 2 + 1""")
def upper_median_threshold(spark, sf_dir):
    return O.upper_median(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")


def _quartile_sql(label: str, q: int) -> str:
    j = f"greatest(1, least((n + 1) * {q} // 4, n - 1))"
    d = f"((n + 1) * {q} - {j} * 4)"
    return (f"round((max(CASE WHEN r = {j} THEN value END) * (4 - max({d})) + max(CASE WHEN r = {j} + 1 THEN value END) * max({d})) / 4, 6) AS {label}")


@query("exclusive_quartiles", "D5",
       f"""SELECT event_type, max(n) AS n, {_quartile_sql('q1', 1)}, {_quartile_sql('q2', 2)}, {_quartile_sql('q3', 3)}
       FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r,
             count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def exclusive_quartiles(spark, sf_dir):
    q = O.exclusive_quartiles(table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")
    return q.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("q1", "q2", "q3")])


@query("temporal_split", "E7 G33",
       """SELECT o_orderkey, CASE WHEN p < floor(n * 0.7) THEN 'train' WHEN p < floor(n * 0.7) + floor(n * 0.15) THEN 'val' ELSE 'test' END AS split
       FROM (SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (ORDER BY day, md5('42:' || o_orderkey), o_orderkey) - 1 AS p
         FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '9999-12-31' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders))""")
def temporal_split(spark, sf_dir):
    from affinityloom.functions.binning import release_day
    day = release_day(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate").cast("string")))
    items = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))
    return S.temporal_split(items, "o_orderkey", "day").select("o_orderkey", "split")


@query("cluster_fill_split", "E8",
       """WITH c AS (SELECT source, count(*) AS size, min(doc_id) AS first_id FROM documents GROUP BY source),
       r AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, md5('42:' || first_id), first_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                    (SELECT count(*) FROM documents) AS n FROM c),
       t AS (SELECT coalesce(sum(size), 0) AS train_size FROM r WHERE before < floor(n * 0.7))
       SELECT d.doc_id, CASE WHEN before < floor(n * 0.7) THEN 'train' WHEN before - train_size < floor(n * 0.15) THEN 'val' ELSE 'test' END AS split
       FROM documents d JOIN r USING (source), t""")
def cluster_fill_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.cluster_fill(docs, "doc_id", "source", "doc_id").select("doc_id", "split")


ALLOCATION_SQL = """
WITH RECURSIVE g AS (SELECT c_nationkey AS grp, count(*) AS size FROM customer GROUP BY 1),
o AS (SELECT grp, size, row_number() OVER (ORDER BY size DESC, md5('42:' || grp), grp) AS rn FROM g),
b AS (SELECT c_nationkey AS grp, c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1, 2),
t AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(floor(count(*) * 0.7::DOUBLE) AS BIGINT) AS tr, CAST(floor(count(*) * 0.15::DOUBLE) AS BIGINT) AS va FROM customer),
goal AS (SELECT n, [tr, va, n - tr - va] AS target FROM t),
segs AS (SELECT list(seg ORDER BY seg) AS names, list(n ORDER BY seg) AS totals FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1)),
gb AS (SELECT o.rn, list(coalesce(b.n, 0) ORDER BY s.seg) AS c FROM o CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) s
       LEFT JOIN b ON b.grp = o.grp AND b.seg = s.seg GROUP BY o.rn),
want AS (SELECT [list_transform(totals, lambda x: greatest(CAST(round_even(x * (target[1] / greatest(n, 1)::DOUBLE), 0) AS BIGINT), 1)),
                 list_transform(totals, lambda x: greatest(CAST(round_even(x * (target[2] / greatest(n, 1)::DOUBLE), 0) AS BIGINT), 1)),
                 list_transform(totals, lambda x: greatest(CAST(round_even(x * (target[3] / greatest(n, 1)::DOUBLE), 0) AS BIGINT), 1))] AS w, target FROM segs, goal),
f AS (
  SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS INT) AS pick, [0, 0, 0]::BIGINT[] AS sizes,
         [list_transform(totals, lambda x: 0::BIGINT), list_transform(totals, lambda x: 0::BIGINT), list_transform(totals, lambda x: 0::BIGINT)] AS counts FROM segs
  UNION ALL
  SELECT rn, pick, list_transform(sizes, lambda v, i: CASE WHEN i = pick THEN v + size ELSE v END),
         list_transform(counts, lambda v, i: CASE WHEN i = pick THEN list_transform(list_zip(v, c), lambda z: z[1] + z[2]) ELSE v END)
  FROM (SELECT q.rn, q.size, q.c, q.sizes, q.counts, list_sort(list_transform([1, 2, 3], lambda i: {'a': (q.sizes[i] + q.size) / greatest(target[i], 1)::DOUBLE,
           'b': list_sum(list_transform(list_zip(q.counts[i], q.c, w[i]), lambda z: CASE WHEN z[2] = 0 THEN 0 ELSE (z[1] + z[2]) / z[3]::DOUBLE END)),
           'name': (['train', 'val', 'test'])[i], 'i': i}))[1].i AS pick
        FROM (SELECT o.rn, o.size, gb.c, f.sizes, f.counts FROM f JOIN o ON o.rn = f.rn + 1 JOIN gb ON gb.rn = o.rn) q, want)
)
SELECT c.c_custkey, (['train', 'val', 'test'])[f.pick] AS split FROM customer c JOIN o ON o.grp = c.c_nationkey JOIN f ON f.rn = o.rn
"""


@query("balanced_group_allocation", "E9", ALLOCATION_SQL)
def balanced_group_allocation(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return S.balanced_allocation(cust, "c_nationkey", "c_mktsegment").select("c_custkey", "split")


@query("resolved_splits", "E16",
       """WITH e AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'train' WHEN doc_id % 10 = 1 OR source = 'src3' THEN 'val' WHEN doc_id % 10 = 2 THEN 'test' END AS x,
            CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS b FROM documents)
       SELECT doc_id, coalesce(x, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END) AS split, x IS NOT NULL AS explicit FROM e""")
def resolved_splits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    ids = docs.withColumn("ids", F.array(F.col("doc_id").cast("string"), F.concat(F.lit("D_"), F.col("doc_id").cast("string")), "source"))
    n = F.col("doc_id") % 10
    listed = docs.filter(n <= 2).select(
        F.when(n == 1, F.concat(F.lit("D_"), F.col("doc_id").cast("string"))).otherwise(F.col("doc_id").cast("string")).alias("member_id"),
        F.when(n == 0, "train").when(n == 1, "val").otherwise("test").alias("split"))
    by_source = docs.filter("source = 'src3'").select(F.col("source").alias("member_id"), F.lit("val").alias("split")).distinct()
    return S.resolve_splits(ids, "doc_id", "ids", listed.unionByName(by_source))


ITEMS_SQL = f"""SELECT doc_id, lang, source, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'h' || (doc_id % 97) END AS hard_key,
  CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END AS band, {HASH_SPLIT_SQL.format(id='doc_id')} AS split FROM documents"""


def split_items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source",
        F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("doc_id") % 97).cast("string"))).alias("hard_key"),
        F.when(F.col("n_chars") < 1000, "short").otherwise("long").alias("band"), hash_split("doc_id").alias("split"))


LONG_SQL = f"""i AS ({ITEMS_SQL}), l AS (SELECT 'lang' AS field, split, lang AS k FROM i UNION ALL SELECT 'source', split, source FROM i
  UNION ALL SELECT 'hard_key', split, hard_key FROM i WHERE hard_key <> '' UNION ALL SELECT 'band', split, band FROM i)"""


@query("split_breakdown", "D8 U4",
       f"""WITH {LONG_SQL}, c AS (SELECT field, split, k, count(*) AS n FROM l GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY field, split ORDER BY n DESC, k) AS rn, count(*) OVER (PARTITION BY field, split) AS u,
             sum(n) OVER (PARTITION BY field, split) AS t FROM c)
       SELECT field, split, u AS unique_count, k AS largest_group_key, n AS largest_group_count, round(n / t::DOUBLE, 6) AS largest_group_fraction FROM r WHERE rn = 1""")
def split_breakdown(spark, sf_dir):
    return S.split_breakdown(split_items(spark, sf_dir), "split", ["lang", "source", "hard_key", "band"])


@query("split_overlap", "D8 F5",
       f"""WITH {LONG_SQL}, s AS (SELECT field, k FROM l GROUP BY field, k HAVING count(DISTINCT split) > 1),
       r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY k) AS rn FROM s)
       SELECT field, count(*) AS overlap_count, array_to_string(list(k ORDER BY k) FILTER (rn <= 5), ',') AS sample_keys FROM r GROUP BY field""")
def split_overlap(spark, sf_dir):
    return S.split_overlap(split_items(spark, sf_dir), "split", ["lang", "source", "hard_key", "band"])


@query("split_status", "D8 D9",
       f"""WITH i AS ({ITEMS_SQL})
       SELECT count(*) FILTER (split = 'train') AS train_count, count(*) FILTER (split = 'val') AS val_count, count(*) FILTER (split = 'test') AS test_count,
         (SELECT count(*) FROM (SELECT hard_key FROM i WHERE hard_key <> '' GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS hard_overlap,
         (SELECT count(*) FROM (SELECT source FROM i GROUP BY 1 HAVING count(DISTINCT split) > 1)) AS family_overlap, 'leakage_risk' AS status FROM i""")
def split_status(spark, sf_dir):
    row = S.split_status(split_items(spark, sf_dir), "split", "hard_key", "source", "lang", "lang", "lang", "band", "band")
    return row.select("train_count", "val_count", "test_count", "hard_overlap", "family_overlap", "status")


@query("split_sizes", "A25",
       f"""SELECT split, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS fraction FROM ({ITEMS_SQL}) GROUP BY split""")
def split_sizes(spark, sf_dir):
    return S.split_sizes(split_items(spark, sf_dir), "split")


@query("heldout_overlap", "C23 D31",
       f"""WITH i AS ({ITEMS_SQL}), p AS (SELECT *, source || '|' || hard_key AS pair FROM i)
       SELECT split, count(*) AS held_out_count,
         count(*) FILTER (source IN (SELECT source FROM p WHERE split = 'train')) AS same_target_count,
         count(*) FILTER (hard_key <> '' AND hard_key IN (SELECT hard_key FROM p WHERE split = 'train')) AS same_ligand_count,
         count(*) FILTER (pair IN (SELECT pair FROM p WHERE split = 'train')) AS exact_pair_count,
         count(*) FILTER (NOT (source IN (SELECT source FROM p WHERE split = 'train')) AND NOT (hard_key <> '' AND hard_key IN (SELECT hard_key FROM p WHERE split = 'train'))) AS novel_count
       FROM p WHERE split <> 'train' GROUP BY split""")
def heldout_overlap(spark, sf_dir):
    items = split_items(spark, sf_dir).withColumn("pair", F.concat_ws("|", "source", "hard_key"))
    return S.heldout_overlap(items, "split", "source", "hard_key", "pair")
