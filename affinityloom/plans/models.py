"""Model, clustering and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import models as M
from affinityloom.operators import selection as SEL
from affinityloom.plans import domain as D
from affinityloom.plans.registry import query, table
from affinityloom.plans.scalars import pick, sql_pick


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("q"), (F.col("l_discount") * 100).alias("d"),
        F.col("l_extendedprice").alias("price"), "l_returnflag")


OLS = """WITH s AS (SELECT count(*)::DOUBLE AS n, sum(l_quantity) AS x, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy FROM lineitem),
w AS (SELECT (n * xy - x * y) / (n * xx - x * x) AS b, (y - (n * xy - x * y) / (n * xx - x * x) * x) / n AS a FROM s)"""


@query("least_squares_weights", "H1", OLS + " SELECT round(a, 2) AS intercept, round(b, 2) AS slope FROM w")
def least_squares_weights(spark, sf_dir):
    w = M.least_squares(lines(spark, sf_dir), ["q"], ["price"])["price"]
    counted = lines(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.round(F.lit(w[0]), 2).alias("intercept"), F.round(F.lit(w[1]), 2).alias("slope"))


@query("linear_prediction_metrics", "H1 H2 D30",
       OLS + """ SELECT l_returnflag, count(*) AS n, round(sqrt(avg((a + b * l_quantity - l_extendedprice) ** 2)), 1) AS rmse, round(avg(abs(a + b * l_quantity - l_extendedprice)), 1) AS mae,
       round(1 - sum((a + b * l_quantity - l_extendedprice) ** 2) / (var_pop(l_extendedprice) * count(*)), 4) + 0.0::DOUBLE AS r2 FROM lineitem, w GROUP BY 1""")
def linear_prediction_metrics(spark, sf_dir):
    rows = lines(spark, sf_dir)
    w = M.least_squares(rows, ["q"], ["price"])["price"]
    scored = rows.withColumn("pred", M.linear_prediction(["q"], w))
    m = M.regression_metrics(scored, "price", "pred", ["l_returnflag"])
    return m.select("l_returnflag", "n", F.round("rmse", 1).alias("rmse"), F.round("mae", 1).alias("mae"), F.round("r2", 4).alias("r2"))


@query("classification_metrics", "D30",
       """SELECT n, round(ok / n::DOUBLE, 6) AS accuracy, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 6) AS f1
       FROM (SELECT count(*) AS n, count(*) FILTER (quality = p) AS ok, count(*) FILTER (quality = 1 AND p = 1) AS tp, count(*) FILTER (quality = 0 AND p = 1) AS fp, count(*) FILTER (quality = 1 AND p = 0) AS fn FROM (SELECT quality, CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)))""")
def classification_metrics(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return M.classification_metrics(d.withColumn("p", F.when(F.col("n_chars") > 800, 1).otherwise(0)), "quality", "p")


@query("feature_schema_stats", "D35",
       """WITH f AS (SELECT event_id, 'all' AS feature, value FROM events UNION ALL SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events WHERE event_id % 3 = 0),
       n AS (SELECT count(*) AS n FROM events), m AS (SELECT feature, sum(value) / any_value(n) AS mean FROM f, n GROUP BY 1)
       SELECT feature, round(any_value(mean), 6) AS mean, round(sqrt((sum((value - mean) ** 2) + (any_value(n) - count(*)) * any_value(mean) ** 2) / any_value(n)), 6) AS std FROM f JOIN m USING (feature), n GROUP BY feature""")
def feature_schema_stats(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    k = F.when(F.col("event_id") % 3 == 0, F.get_json_object("props", "$.k").cast("double"))
    long = ev.select("event_id", F.inline(F.array(
        F.struct(F.lit("all").alias("feature"), F.col("value").alias("value")), F.struct(F.col("event_type").alias("feature"), F.col("value").alias("value")),
        F.struct(F.lit("k").alias("feature"), k.alias("value"))))).filter("value IS NOT NULL")
    return M.feature_stats(long, "event_id")


PROFILE_SQL = """WITH w AS (SELECT event_id, 'T' || (user_id % 20) AS target, 1 + (event_id % 5) * 0.05::DOUBLE AS weight FROM events), f AS (SELECT event_id, event_type AS feature, value FROM events UNION ALL SELECT event_id, 'k', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events),
t AS (SELECT target, sum(weight) AS total FROM w GROUP BY 1), p AS (SELECT target, feature, round(sum(value * weight) / any_value(total), 6) AS mean_value FROM f JOIN w USING (event_id) JOIN t USING (target) GROUP BY 1, 2)"""


def profiles(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    w = ev.select("event_id", D.numbered("T", F.col("user_id") % 20).alias("target"), (1 + (F.col("event_id") % 5) * 0.05).alias("weight"))
    rows = ev.select("event_id", F.inline(F.array(
        F.struct(F.col("event_type").alias("feature"), F.col("value").alias("value")),
        F.struct(F.lit("k").alias("feature"), F.get_json_object("props", "$.k").cast("double").alias("value")))))
    return M.target_profiles(rows, w, "target", "event_id")


@query("target_profiles", "D23", PROFILE_SQL + " SELECT * FROM p")
def target_profiles(spark, sf_dir):
    return profiles(spark, sf_dir)


@query("target_priors", "D23",
       PROFILE_SQL + " SELECT target, round((least(greatest(coalesce(max(mean_value) FILTER (feature = 'view'), 0), 0), 20) / 20 + 1 - least(greatest(coalesce(max(mean_value) FILTER (feature = 'k'), 0), 0), 80) / 80) / 2, 4) AS prior FROM p GROUP BY 1")
def target_priors(spark, sf_dir):
    return M.target_prior(profiles(spark, sf_dir), "target", {"view": (20.0, False), "k": (80.0, True)})


@query("query_conditioned_rows", "B17",
       "SELECT o_orderkey, 9.5::DOUBLE AS ligand, o_totalprice AS price, 2 AS feature_count FROM orders")
def query_conditioned_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.create_map(F.lit("price"), F.col("o_totalprice"), F.lit("ligand"), F.col("o_custkey").cast("double")).alias("features"))
    return M.query_conditioned(rows, "features", {"ligand": 9.5}).select(
        "o_orderkey", F.col("features")["ligand"].alias("ligand"), F.col("features")["price"].alias("price"), F.size("features").alias("feature_count"))


KMEANS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS p, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
nn AS (SELECT count(*) AS n FROM v), st AS (SELECT CAST('0x' || substr(md5('kmeans:42:' || n), 1, 8) AS BIGINT) % n AS s, n FROM nn),
c0 AS MATERIALIZED (SELECT list(e ORDER BY i) AS cs FROM (SELECT i, e FROM (SELECT unnest(range(0, 4)) AS i), st JOIN v ON v.p = (s + i) % n)),
it AS (SELECT 0 AS r, cs FROM c0 UNION ALL SELECT r + 1, (SELECT list(coalesce(m.c, cs[j]) ORDER BY j) FROM (SELECT unnest(range(1, 5)) AS j) js LEFT JOIN (
   SELECT k, [round(avg(e[1]), 9), round(avg(e[2]), 9), round(avg(e[3]), 9), round(avg(e[4]), 9)] AS c FROM (SELECT e, list_sort(list_transform([1, 2, 3, 4], lambda j: {'d': (e[1] - cs[j][1]) ** 2 + (e[2] - cs[j][2]) ** 2 + (e[3] - cs[j][3]) ** 2 + (e[4] - cs[j][4]) ** 2, 'j': j}))[1].j AS k FROM v) GROUP BY k) m ON m.k = js.j)
   FROM it WHERE r < 11)
SELECT vec_id, list_sort(list_transform([1, 2, 3, 4], lambda j: {'d': (e[1] - cs[j][1]) ** 2 + (e[2] - cs[j][2]) ** 2 + (e[3] - cs[j][3]) ** 2 + (e[4] - cs[j][4]) ** 2, 'j': j}))[1].j - 1 AS cluster FROM v, it WHERE r = 11"""


@query("kmeans_clusters", "H3", KMEANS_SQL)
def kmeans_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 4).alias("v"))
    return M.kmeans(rows, "vec_id", "v", 4, decimals=9)


@query("kmeans_clusters_all", "H3")
def kmeans_clusters_all(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return M.kmeans(rows, "vec_id", "v", 4, decimals=9)


ARCH_SQL = f"""SELECT vec_id, label AS motif, list_transform(embedding[1:3], lambda x: round(CAST(x AS DOUBLE) * 4)) AS v FROM embeddings"""


def archetype_rows(spark, sf_dir):
    return rounded_vectors(spark, sf_dir, F.slice("embedding", 1, 3))


def rounded_vectors(spark, sf_dir, embedding):
    v = F.transform(embedding, lambda x: F.round(x.cast("double") * 4))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("motif"), v.alias("v"))


ARCH_WALK = f"""WITH RECURSIVE a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY motif ORDER BY vec_id) AS rn FROM ({ARCH_SQL})),
w AS (SELECT motif, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS vec_id, []::DOUBLE[][] AS cents, []::BIGINT[] AS heads, CAST(0 AS BIGINT) AS pick FROM (SELECT DISTINCT motif FROM a)
  UNION ALL SELECT motif, rn, vec_id, CASE WHEN pick > len(heads) THEN list_append(cents, v) ELSE cents END, CASE WHEN pick > len(heads) THEN list_append(heads, vec_id) ELSE heads END, pick
  FROM (SELECT a.motif, a.rn, a.vec_id, a.v, w.cents, w.heads, coalesce(list_min(list_filter(range(1, len(w.heads) + 1), lambda i: (abs(a.v[1] - w.cents[i][1]) / greatest(abs(a.v[1]), abs(w.cents[i][1]), 1) + abs(a.v[2] - w.cents[i][2]) / greatest(abs(a.v[2]), abs(w.cents[i][2]), 1)
     + abs(a.v[3] - w.cents[i][3]) / greatest(abs(a.v[3]), abs(w.cents[i][3]), 1)) / 3 <= 0.15)), len(w.heads) + 1) AS pick FROM w JOIN a ON a.motif = w.motif AND a.rn = w.rn + 1)),
cl AS (SELECT motif, vec_id, CAST(pick - 1 AS INT) AS cluster_index, heads[pick] AS leader FROM w WHERE rn > 0)"""


@query("archetype_clusters", "E12 G29", ARCH_WALK + " SELECT * FROM cl")
def archetype_clusters(spark, sf_dir):
    return SEL.archetype_clusters(archetype_rows(spark, sf_dir), "motif", "vec_id", "v", batch=16)


@query("archetype_clusters_all", "E12 G29")
def archetype_clusters_all(spark, sf_dir):
    return SEL.archetype_clusters(rounded_vectors(spark, sf_dir, F.col("embedding")), "motif", "vec_id", "v", batch=16)


@query("archetype_representatives", "D26", ARCH_WALK + " SELECT motif, cluster_index, count(*) AS cluster_size, arg_min(md5(CAST(vec_id AS VARCHAR)), md5(CAST(vec_id AS VARCHAR))) AS representative_archetype FROM cl GROUP BY 1, 2")
def archetype_representatives(spark, sf_dir):
    m = archetype_clusters(spark, sf_dir).withColumn("archetype", F.md5(F.col("vec_id").cast("string")))
    return SEL.cluster_representatives(m, ["motif", "cluster_index"], "archetype", "vec_id").select(
        "motif", "cluster_index", "cluster_size", "representative_archetype")


@query("analysis_queue", "E14",
       """SELECT p_type, array_to_string(list(p_name || p_partkey ORDER BY p_name || p_partkey), ',') AS archetype_ids FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_name || p_partkey) AS rn FROM part) WHERE rn <= 20 GROUP BY 1""")
def analysis_queue(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_type", F.concat("p_name", F.col("p_partkey").cast("string")).alias("a"))
    return SEL.queue_batches(p, "p_type", "a").select("p_type", F.array_join("archetype_ids", ",").alias("archetype_ids"))


def candidate_pool(spark, sf_dir):
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        n.cast("string").alias("candidate_id"), F.round(F.col("n_chars") / 20000.0, 6).alias("base_score"),
        F.sort_array(F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), pick(["m:a", "m:b", "m:c"], n))).alias("tokens"),
        F.concat(F.lit("c"), (n % 137).cast("string")).alias("cluster"), F.concat(F.lit("f"), (n % 401).cast("string")).alias("family"),
        F.concat(F.lit("i"), (n % 59).cast("string")).alias("identity"))


@query("diverse_selection", "E10")
def diverse_selection(spark, sf_dir):
    return SEL.diverse_selection(candidate_pool(spark, sf_dir), 60)


@query("selection_exclusions", "F7 E10")
def selection_exclusions(spark, sf_dir):
    pool = candidate_pool(spark, sf_dir)
    return SEL.selection_exclusions(pool, SEL.diverse_selection(pool, 60), 1)


def learner_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("size"), (F.length("text") - F.length(F.regexp_replace("text", " ", ""))).cast("double").alias("spaces"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"), (F.length(F.regexp_replace("text", "[^0-9]", ""))).cast("double").alias("digits"))
    return docs, docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("label", F.col("quality").cast("double"))


FEATURES = ["size", "spaces", "lines", "digits"]


@query("supervised_families", "H4")
def supervised_families(spark, sf_dir):
    from affinityloom.functions.hashing import hash_split
    from affinityloom.operators.learners import fit_family
    rows = learner_rows(spark, sf_dir)[1].withColumn("split", hash_split("doc_id", 0.7, 0.15)).cache()
    out = None
    for family in ("random_forest", "boosted_trees", "dense_network"):
        model = fit_family(rows.filter("split = 'train'"), FEATURES, "label", family, "classification", trees=10, depth=4)
        m = M.classification_metrics(model.transform(rows), "label", "prediction", ["split"]).withColumn("family", F.lit(family))
        out = m if out is None else out.unionByName(m)
    return out


@query("batch_inference", "H8")
def batch_inference(spark, sf_dir):
    from affinityloom.operators.learners import batch_inference as infer
    from affinityloom.operators.learners import fit_family
    docs, rows = learner_rows(spark, sf_dir)
    model = fit_family(rows, FEATURES, "label", "random_forest", "classification", trees=10, depth=4)
    ids = docs.select("doc_id").unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id")).filter("doc_id % 10 = 0"))
    return infer(model, ids, docs.withColumn("digits", F.when(F.col("doc_id") % 7 > 0, F.col("digits"))), "doc_id", FEATURES)


@query("embedding_clusters", "H5")
def embedding_clusters(spark, sf_dir):
    from affinityloom.operators.learners import embed_and_cluster
    placed, metrics = embed_and_cluster(table(spark, sf_dir, "embeddings"), "embedding")
    return placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("silhouette", F.lit(metrics["silhouette"]))


@query("reconstruction_errors", "H5")
def reconstruction_errors(spark, sf_dir):
    from affinityloom.operators.learners import reconstruction_error
    return reconstruction_error(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("site_physics_surrogate", "H6 C21",
       f"""WITH d AS (SELECT {sql_pick(['a', 'b', 'c'], 'l_partkey')} AS motif, l_quantity AS x, l_extendedprice AS y, l_tax * 100 AS z FROM lineitem),
       g AS (SELECT motif, count(*)::DOUBLE AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_pop(x, y) / var_pop(x) AS by_, covar_pop(x, z) / var_pop(x) AS bz FROM d GROUP BY 1)
       SELECT motif, round(by_, 2) AS slope_price, round(my - by_ * mx, 1) AS base_price, round(bz, 4) + 0.0::DOUBLE AS slope_tax FROM g""")
def site_physics_surrogate(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(pick(["a", "b", "c"], F.col("l_partkey")).alias("motif"), F.col("l_quantity").alias("x"),
                                                   F.col("l_extendedprice").alias("y"), (F.col("l_tax") * 100).alias("z"))
    return M.grouped_least_squares(rows, "motif", "x", ["y", "z"]).select(
        "motif", F.round("slope_y", 2).alias("slope_price"), F.round("base_y", 1).alias("base_price"), F.round("slope_z", 4).alias("slope_tax"))
