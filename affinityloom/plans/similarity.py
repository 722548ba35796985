"""Similarity and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import similarity as J
from affinityloom.plans.registry import query, table

WORDS = r"[A-Za-zÀ-ÿ]+"

# The SQL side finds the same pairs by a prefix of rare tokens, then counts shared tokens directly.
SETS_SQL = """tok AS (SELECT DISTINCT {id} AS id, unnest({tokens}) AS t FROM {table}),
sz AS (SELECT id, count(*) AS n FROM tok GROUP BY 1), fr AS (SELECT t, count(*) AS f FROM tok GROUP BY 1),
rk AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY f, t) AS r, n FROM tok JOIN fr USING (t) JOIN sz USING (id)),
pre AS (SELECT id, t, n FROM rk WHERE r <= n - ceil({th}::DOUBLE * n - 1e-9) + 1),
sigs AS (SELECT id, md5(string_agg(t, '|' ORDER BY t)) AS g FROM tok GROUP BY 1),
rep AS (SELECT id, min(id) OVER (PARTITION BY g) AS rep FROM sigs),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b ON a.t = b.t AND a.id < b.id AND a.n >= {th}::DOUBLE * b.n - 1e-6 AND b.n >= {th}::DOUBLE * a.n - 1e-6
  WHERE a.id IN (SELECT rep FROM rep) AND b.id IN (SELECT rep FROM rep)),
prs AS (SELECT a, b, count(*) / (any_value(na) + any_value(nb) - count(*))::DOUBLE AS s FROM cand JOIN tok x ON x.id = a JOIN tok y ON y.id = b AND x.t = y.t GROUP BY a, b HAVING count(*) / (any_value(na) + any_value(nb) - count(*))::DOUBLE >= {th})"""


def kmer_sql(col: str, k: int) -> str:
    return f"list_transform(range(1, length({col}) - {k} + 2), lambda i: substr({col}, i, {k}))"


DOC_WORDS = SETS_SQL.format(id="doc_id", tokens=f"regexp_extract_all(text, '{WORDS}')", table="documents", th=0.5)


def document_sets(spark, sf_dir, *facts):
    return table(spark, sf_dir, "documents").select("doc_id", J.pattern_tokens("text", WORDS).alias("tokens"), *facts)


@query("similar_set_pairs", "C18 C12", f"WITH {DOC_WORDS} SELECT a, b, round(s, 6) AS similarity FROM prs")
def similar_set_pairs(spark, sf_dir):
    reps, _ = J.collapse_copies(document_sets(spark, sf_dir), "doc_id", "doc_id")
    return J.similar_pairs(reps, "doc_id", 0.5).withColumn("similarity", F.round("similarity", 6))


@query("copy_representatives", "C18", f"WITH {DOC_WORDS} SELECT id AS doc_id, rep AS representative FROM rep")
def copy_representatives(spark, sf_dir):
    return J.collapse_copies(document_sets(spark, sf_dir), "doc_id", "doc_id")[1].select("doc_id", "representative")


DOC_KMERS = SETS_SQL.format(id="doc_id", tokens=kmer_sql("text", 8), table="documents", th=0.6)


def document_kmers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", J.kmer_tokens("text", 8).alias("tokens"))


@query("similar_kmer_pairs", "C18", f"WITH {DOC_KMERS} SELECT a, b, round(s, 6) AS similarity FROM prs")
def similar_kmer_pairs(spark, sf_dir):
    reps, _ = J.collapse_copies(document_kmers(spark, sf_dir), "doc_id", "doc_id")
    return J.similar_pairs(reps, "doc_id", 0.6).withColumn("similarity", F.round("similarity", 6))


LEADERS = """, nb AS MATERIALIZED (SELECT r.rep AS id, coalesce(e.l, []) AS earlier, row_number() OVER (ORDER BY r.rep) AS rn FROM (SELECT DISTINCT rep FROM rep) r LEFT JOIN (SELECT b, list(a) AS l FROM prs GROUP BY b) e ON e.b = r.rep),
walk AS (SELECT CAST(0 AS BIGINT) AS rn, []::BIGINT[] AS leaders, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS leader
  UNION ALL SELECT nb.rn, CASE WHEN list_has_any(walk.leaders, nb.earlier) THEN walk.leaders ELSE list_append(walk.leaders, nb.id) END, nb.id,
    CASE WHEN list_has_any(walk.leaders, nb.earlier) THEN list_min(list_intersect(walk.leaders, nb.earlier)) ELSE nb.id END FROM walk JOIN nb ON nb.rn = walk.rn + 1)"""


@query("leader_clusters", "E11 C18", f"WITH RECURSIVE {DOC_WORDS}{LEADERS} SELECT rep.id AS doc_id, walk.leader FROM rep JOIN walk ON walk.id = rep.rep")
def leader_clusters(spark, sf_dir):
    return J.leader_clusters(document_sets(spark, sf_dir), "doc_id", 0.5)


CROSS_SQL = f"""qt AS (SELECT DISTINCT item_id AS q, unnest(regexp_extract_all(text, '{WORDS}')) AS t FROM benchmark), dt AS (SELECT DISTINCT doc_id AS d, unnest(regexp_extract_all(text, '{WORDS}')) AS t FROM documents),
qn AS (SELECT q, count(*) AS n FROM qt GROUP BY 1), dn AS (SELECT d, count(*) AS n FROM dt GROUP BY 1),
sim AS (SELECT q AS item_id, d AS doc_id, count(*) / (any_value(qn.n) + any_value(dn.n) - count(*))::DOUBLE AS s FROM qt JOIN dt USING (t) JOIN qn USING (q) JOIN dn USING (d) GROUP BY q, d HAVING count(*) / (any_value(qn.n) + any_value(dn.n) - count(*))::DOUBLE > 0)"""


def query_matches(spark, sf_dir, *facts, best=None):
    """Matches with the named facts of their documents."""
    q = table(spark, sf_dir, "benchmark").select("item_id", J.pattern_tokens("text", WORDS).alias("tokens"))
    docs = document_sets(spark, sf_dir, *facts)
    return J.all_matches(q, docs, "item_id", "doc_id", carry=docs.columns[2:], best=best)


@query("query_similarity_join", "C12", f"WITH {CROSS_SQL} SELECT item_id, doc_id, round(s, 6) AS similarity FROM sim")
def query_similarity_join(spark, sf_dir):
    return query_matches(spark, sf_dir).withColumn("similarity", F.round("similarity", 6))


TARGETS_SQL = """, sc AS (SELECT s.item_id, d.source AS target, s.doc_id, s.s, 1 + (d.doc_id % 5) * 0.05::DOUBLE AS w, CASE WHEN d.n_chars > 0 THEN log10(d.n_chars) END AS l FROM sim s JOIN documents d USING (doc_id)),
ag AS (SELECT item_id, target, sum(s * w * greatest(greatest(0.0, least(1.0, 1 - l / 6)), 0.01)) AS raw, sum(s * w * l) / sum(s * w) AS mean_log, max(s) AS best, count(*) AS n FROM sc GROUP BY 1, 2)"""


@query("target_ranking", "E13 G24",
       f"WITH {CROSS_SQL}{TARGETS_SQL} SELECT item_id, target, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 9) DESC, target) AS INT) AS rank, round(1 / (1 + exp(-raw)), 4) AS confidence, round(best, 4) AS similarity, round(-1.364 * mean_log, 3) AS free_energy, n AS support FROM ag")
def target_ranking(spark, sf_dir):
    from affinityloom.operators.models import rank_targets
    matches = query_matches(
        spark, sf_dir, F.col("source").alias("target"), (1 + (F.col("doc_id") % 5) * 0.05).alias("weight"),
        F.when(F.col("n_chars") > 0, F.log10("n_chars")).alias("log_value"))
    return rank_targets(matches, "item_id", "target", "doc_id").select(
        "item_id", "target", "rank", "confidence", "similarity", "free_energy", "support")


@query("supporting_examples", "E13",
       f"WITH {CROSS_SQL}{TARGETS_SQL} SELECT item_id, target, doc_id, CAST(row_number() OVER (PARTITION BY item_id, target ORDER BY s DESC, doc_id) AS INT) AS position FROM sc QUALIFY row_number() OVER (PARTITION BY item_id, target ORDER BY s DESC, doc_id) <= 5")
def supporting_examples(spark, sf_dir):
    from affinityloom.operators.models import top_support
    matches = query_matches(spark, sf_dir, F.col("source").alias("target"), best=(5, "target"))
    return top_support(matches, "item_id", "target", "doc_id").select("item_id", "target", "doc_id", "position")


@query("hit_rates", "D31",
       f"WITH {CROSS_SQL}{TARGETS_SQL}, rk AS (SELECT item_id, target, row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 9) DESC, target) AS r FROM ag) SELECT count(*) AS queries, round(avg(CASE WHEN coalesce(r, 99) <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN coalesce(r, 99) <= 3 THEN 1.0 ELSE 0 END), 6) AS top3 FROM benchmark b LEFT JOIN rk ON rk.item_id = b.item_id AND rk.target = 'src' || (b.item_id % 20)")
def hit_rates(spark, sf_dir):
    return rates_of(target_ranking(spark, sf_dir), spark, sf_dir)


def rates_of(ranking, spark, sf_dir):
    from affinityloom.operators.models import hit_rates as rates
    truth = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("target"))
    return rates(ranking, truth, "item_id", "target")
