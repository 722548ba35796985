"""Audit, distribution and rollup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import rollups as A
from affinityloom.plans import domain as D
from affinityloom.plans.registry import query, table
from affinityloom.plans.splits import ITEMS_SQL, split_items


@query("distributions", "D6 D7 D29",
       """SELECT 'lang' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
       UNION ALL SELECT 'word', w, count(*) FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) AS w FROM documents) WHERE trim(w) <> '' GROUP BY 2""")
def distributions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return A.distribution(docs, {"lang": F.col("lang"), "source": F.col("source"),
                                 "word": F.split("text", "[\n ]")})


@query("missing_counts", "D6", "SELECT 'lang' AS field, count(*) FILTER (lang = 'xx') AS missing FROM documents UNION ALL SELECT 'blank_source', count(*) FILTER (source = 'src1') FROM documents")
def missing_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.when(F.col("source") != "src1", F.col("source")).alias("blank_source"))
    return A.missing_counts(docs, ["lang", "blank_source"])


@query("top_distribution_values", "D5 D29",
       """SELECT dimension, value, n FROM (SELECT 'source' AS dimension, source AS value, count(*) AS n FROM documents GROUP BY 2) QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 10""")
def top_distribution_values(spark, sf_dir):
    return A.top_values(A.distribution(table(spark, sf_dir, "documents"), {"source": F.col("source")}), ["dimension"], 10)


def _population_sql(t: str, cols: list[str], tracked: list[str]) -> str:
    parts = []
    for c in cols:
        v = f"trim(coalesce(CAST({c} AS VARCHAR), ''))"
        frac = f"round(count(*) FILTER ({v} <> '') / count(*)::DOUBLE, 4)"
        status = f"CASE WHEN count(*) FILTER ({v} <> '') = 0 THEN 'empty' WHEN {frac} < 0.1 THEN 'sparse' WHEN {frac} < 0.6 THEN 'partial' ELSE 'populated' END"
        role = "'untracked'" if c not in tracked else f"CASE WHEN {status} IN ('empty', 'sparse') THEN 'quarantined' ELSE 'decision_grade' END"
        parts.append(f"SELECT '{c}' AS field, count(*) FILTER ({v} <> '') AS non_empty_count, {frac} AS non_empty_fraction, count(DISTINCT {v}) FILTER ({v} <> '') AS distinct_count, {status} AS status, {role} AS policy_role FROM {t}")
    return " UNION ALL ".join(parts)


@query("field_population_audit", "D11",
       "WITH o AS (SELECT *, CASE WHEN o_orderkey % 20 = 0 THEN 'x' END AS rare, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE 'y' END AS half, '' AS never FROM orders) "
       + _population_sql("o", ["o_orderkey", "o_orderstatus", "o_orderpriority", "rare", "half", "never"], ["o_orderstatus", "rare", "half", "never"]))
def field_population_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("rare", F.when(F.col("o_orderkey") % 20 == 0, "x")).withColumn(
        "half", F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("y")).withColumn("never", F.lit(""))
    return A.field_population(o, ["o_orderkey", "o_orderstatus", "o_orderpriority", "rare", "half", "never"],
                              ["o_orderstatus", "rare", "half", "never"])


@query("audit_flag_counts", "D4",
       """SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN source = 'src1' THEN 'first_source' END], lambda x: x IS NOT NULL)) AS flag FROM documents) GROUP BY 1""")
def audit_flag_counts(spark, sf_dir):
    from affinityloom.functions.quality import named
    docs = table(spark, sf_dir, "documents").select(
        named([(F.col("n_chars") > 3000, "long"), (F.col("lang") != "en", "foreign"), (F.col("source") == "src1", "first_source")]).alias("flags"),
        F.col("n_chars").alias("score"))
    return A.audit_summary(docs, "flags", "score")[0]


@query("audit_score_stats", "D4", "SELECT count(*) AS n, round(avg(n_chars), 4) AS mean, min(n_chars) AS lowest, max(n_chars) AS highest FROM documents")
def audit_score_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.array(F.lit("x")).alias("flags"), F.col("n_chars").alias("score"))
    return A.audit_summary(docs, "flags", "score")[1]


@query("field_coverage", "D5",
       """SELECT 'quality' AS field, count(quality) AS present, round(count(quality) * 100.0::DOUBLE / count(*), 1) AS percent FROM documents LEFT JOIN labels USING (doc_id)
       UNION ALL SELECT 'lang', count(lang), round(count(lang) * 100.0::DOUBLE / count(*), 1) FROM documents""")
def field_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return A.coverage_percent(d, ["quality", "lang"])


@query("training_quality_report", "D10",
       """SELECT count(*) AS example_count, count(quality) AS supervised_count, count(*) FILTER (toxic = 1) AS conflict_count, count(*) FILTER (lang = 'de') AS mutation_count,
         0::BIGINT AS degraded_count, count(*) AS target_count, count(*) AS ligand_count, count(DISTINCT source) AS unique_targets, count(DISTINCT lang) AS unique_ligands,
         count(DISTINCT source || '|' || lang) AS unique_pairs, CASE WHEN count(DISTINCT lang) < 5 THEN 'undersized' ELSE 'usable_with_gaps' END AS readiness
       FROM documents LEFT JOIN labels USING (doc_id)""")
def training_quality_report(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("quality").alias("label"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("conflict"), (F.col("lang") == "de").alias("mutant"),
        F.lit(False).alias("degraded"), F.col("source").alias("target"), F.col("lang").alias("ligand"), F.concat_ws("|", "source", "lang").alias("pair"))
    return A.training_quality(d, {k: k for k in ("label", "conflict", "mutant", "degraded", "target", "ligand", "pair")})


@query("entity_set_rollup", "D12 D13",
       """SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '; ') AS o_orderstatus, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '; ') AS o_orderpriority, count(*) AS orders FROM orders GROUP BY 1""")
def entity_set_rollup(spark, sf_dir):
    return A.set_rollup(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"], [F.count(F.lit(1)).alias("orders")])


@query("identity_member_list", "D13", "SELECT l_suppkey, l_partkey, min(l_orderkey) AS first_ordinal, count(*) AS row_count FROM lineitem GROUP BY 1, 2")
def identity_member_list(spark, sf_dir):
    return A.member_list(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", "l_orderkey")


@query("id_universe", "F4 D12",
       """SELECT k, bool_or(s = 'docs') AS has_docs, bool_or(s = 'labels') AS has_labels, bool_or(s = 'pages') AS has_pages FROM (SELECT doc_id AS k, 'docs' AS s FROM documents UNION ALL SELECT doc_id, 'labels' FROM labels UNION ALL SELECT page_id, 'pages' FROM pages) GROUP BY 1""")
def id_universe(spark, sf_dir):
    return A.id_universe({"docs": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k")),
                          "labels": table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k")),
                          "pages": table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"))}, "k")


COUNTERS_SQL = "SELECT 'S' || (user_id % 7) AS source, event_type AS status, CASE WHEN event_id % 2 = 0 THEN 'bulk' ELSE 'api' END AS mode, count(*) AS attempts, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS records FROM events {where} GROUP BY ALL"


def counter_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", D.numbered("S", F.col("user_id") % 7).alias("source"), F.col("event_type").alias("status"),
        F.when(F.col("event_id") % 2 == 0, "bulk").otherwise("api").alias("mode"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "ts")


@query("source_counters", "D25", COUNTERS_SQL.format(where=""))
def source_counters(spark, sf_dir):
    return A.source_counters(counter_events(spark, sf_dir), "source", "status", "mode", "k")


@query("source_counter_delta", "D25",
       f"""WITH a AS ({COUNTERS_SQL.format(where='')}), b AS ({COUNTERS_SQL.format(where="WHERE ts < TIMESTAMP '2024-01-15'")})
       SELECT a.source, a.status, a.mode, a.attempts - coalesce(b.attempts, 0) AS attempts, a.records - coalesce(b.records, 0) AS records FROM a LEFT JOIN b USING (source, status, mode) WHERE a.attempts > coalesce(b.attempts, 0) OR a.records > coalesce(b.records, 0)""")
def source_counter_delta(spark, sf_dir):
    ev = counter_events(spark, sf_dir)
    after = A.source_counters(ev, "source", "status", "mode", "k")
    before = A.source_counters(ev.filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")), "source", "status", "mode", "k")
    return A.counter_delta(before, after, ["source", "status", "mode"], ["attempts", "records"])


def _conc_sql(mode: str, c: str) -> str:
    return f"""SELECT '{mode}' AS mode, count(*) AS group_count, max(n) AS largest, count(*) FILTER (n = 1) AS singletons, round(avg(n), 4) AS mean_size,
      round(max(n) / sum(n)::DOUBLE, 4) AS largest_fraction, array_to_string((list(v || '=' || n ORDER BY n DESC, v))[1:5], '; ') AS dominant FROM (SELECT CASE WHEN {c} = '' THEN 'unknown' ELSE {c} END AS v, count(*) AS n FROM ({ITEMS_SQL}) GROUP BY 1)"""


@query("group_concentration", "D24", " UNION ALL ".join(_conc_sql(m, c) for m, c in (("split", "split"), ("hard", "hard_key"), ("source", "source"))))
def group_concentration(spark, sf_dir):
    return A.group_concentration(split_items(spark, sf_dir), {"split": F.col("split"), "hard": F.col("hard_key"), "source": F.col("source")})


@query("expected_outcome_mismatches", "D36",
       """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 3 = 0 AND NOT p_size > 25 THEN 'large' END, CASE WHEN (p_type = 'ECONOMY') <> (p_partkey % 2 = 0) THEN 'economy' END) AS mismatches,
         CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS compared FROM part""")
def expected_outcome_mismatches(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    got = p.select("p_partkey", (F.col("p_size") > 25).alias("large"), (F.col("p_type") == "ECONOMY").alias("economy"))
    want = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, True).alias("large"), (F.col("p_partkey") % 2 == 0).alias("economy"))
    return A.outcome_mismatches(got, want, "p_partkey", ["large", "economy"])


@query("model_split_winners", "D32",
       """SELECT s AS split, CASE WHEN a < b THEN 'mean_a' WHEN b < a THEN 'mean_b' ELSE 'tie' END AS winner FROM (SELECT event_type AS s,
         CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_id % 2 = 0) AS DOUBLE) AS a, CAST(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_id % 2 = 1) AS DOUBLE) AS b FROM events GROUP BY 1)""")
def model_split_winners(spark, sf_dir):
    v = F.col("value").cast("decimal(18,2)")
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("split")).agg(
        F.sum(F.when(F.col("event_id") % 2 == 0, v)).cast("double").alias("mean_a"), F.sum(F.when(F.col("event_id") % 2 == 1, v)).cast("double").alias("mean_b"))
    return A.split_winners(m, "mean_a", "mean_b").select("split", "winner")


@query("run_ranking", "D32",
       """SELECT metric, run, CAST(row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'max' THEN -v ELSE v END, run) AS INT) AS rank FROM (
         SELECT 'max' AS metric, c_mktsegment || c_nationkey AS run, max(c_acctbal) AS v FROM customer GROUP BY 2 UNION ALL SELECT 'min', c_mktsegment || c_nationkey, min(c_acctbal) FROM customer GROUP BY 2)""")
def run_ranking(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("run"), "c_acctbal")
    runs = c.groupBy("run").agg(F.max("c_acctbal").alias("v"), F.lit("max").alias("metric"), F.lit(True).alias("up")).unionByName(
        c.groupBy("run").agg(F.min("c_acctbal").alias("v"), F.lit("min").alias("metric"), F.lit(False).alias("up")))
    return A.run_ranking(runs, "up", "v", "run").select("metric", "run", "rank")


@query("pathway_risk_summary", "D28 F3",
       """WITH p AS (SELECT l_suppkey, l_partkey, log10(l_extendedprice) AS lv, l_returnflag = 'R' AS c FROM lineitem), w AS (SELECT DISTINCT l_suppkey AS protein, l_partkey % 40 AS pathway FROM lineitem),
       h AS (SELECT * FROM p WHERE l_suppkey IN (3, 5) OR l_suppkey + 1 IN (3, 5)), a AS (SELECT DISTINCT pathway FROM w WHERE protein IN (3, 5)),
       b AS (SELECT DISTINCT pathway FROM w WHERE protein IN (SELECT l_suppkey FROM h UNION SELECT l_suppkey + 1 FROM h)),
       s AS (SELECT count(*) AS n, count(*) FILTER (c) AS cc, greatest(0.0, least(1.0, 1 - avg(lv) / 6)) AS st FROM h), o AS (SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS ov, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS un)
       SELECT n AS pair_count, cc AS conflict_count, ov AS overlap_count, un AS union_count, round(st, 4) AS binding_strength, round(ov / un::DOUBLE, 4) AS pathway_similarity,
         round(greatest(0.0, 0.45 * st + 0.35 * ov / un::DOUBLE - 0.25 * cc / n::DOUBLE), 4) AS risk_score,
         CASE WHEN 0.45 * st + 0.35 * ov / un::DOUBLE - 0.25 * cc / n::DOUBLE >= 0.7 THEN 'high' WHEN 0.45 * st + 0.35 * ov / un::DOUBLE - 0.25 * cc / n::DOUBLE >= 0.35 THEN 'medium' ELSE 'low' END AS severity FROM s, o""")
def pathway_risk_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    pairs = li.select(F.array(F.col("l_suppkey").cast("string"), (F.col("l_suppkey") + 1).cast("string")).alias("receptor"),
                      F.log10("l_extendedprice").alias("log_value"), (F.col("l_returnflag") == "R").alias("conflict"))
    paths = li.select(F.col("l_suppkey").cast("string").alias("protein"), (F.col("l_partkey") % 40).alias("pathway")).distinct()
    return A.pathway_risk(pairs, paths, ["3", "5"])


@query("dataset_diversity", "D27",
       f"""SELECT count(*) AS row_count, count(*) FILTER (split = 'train') AS train_count, count(DISTINCT source) AS family_diversity, count(DISTINCT lang) AS organism_diversity, count(DISTINCT hard_key) FILTER (hard_key <> '') AS group_diversity FROM ({ITEMS_SQL})""")
def dataset_diversity(spark, sf_dir):
    items = split_items(spark, sf_dir)
    return items.agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("split") == "train").alias("train_count"),
                     F.countDistinct("source").alias("family_diversity"), F.countDistinct("lang").alias("organism_diversity"),
                     F.countDistinct(F.nullif("hard_key", F.lit(""))).alias("group_diversity"))
