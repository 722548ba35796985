"""The joint site-physics surrogate: targets, archetypes and site features derived from line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import joins as J
from affinityloom.operators import surrogate as S
from affinityloom.plans.registry import query, table
from affinityloom.plans.scalars import pick, sql_pick

# The target columns of the physics tables.
TARGETS = [
    "refined_partial_charge", "electrostatic_potential", "electric_field_magnitude", "donor_strength", "acceptor_strength",
    "polarizability_proxy", "effective_steric_radius", "desolvation_penalty_proxy", "protonation_preference_score",
    "metal_binding_propensity", "aromatic_interaction_propensity", "local_environment_strain_score"]
FEATURES = ["geometry.neighbor_site_count", "shell_1.mean_charge"]
MOTIFS = ["acidic", "basic", "polar"]

# One value per line item and target; the fourth target lacks every seventh part's.
VALUE = "l_quantity * ({t} + 1) + l_discount * 100 * ({t} % 3) + l_tax * 100 * ({t} % 4) - l_linenumber * ({t} % 5)"

FIT_SQL = f"""WITH d AS (SELECT *, {sql_pick(MOTIFS, 'l_partkey')} AS motif, l_orderkey * 8 + l_linenumber AS archetype FROM lineitem),
f AS (SELECT l_suppkey, motif, count(*)::DOUBLE AS x1, sum(l_quantity)::DOUBLE / count(*) AS x2 FROM d GROUP BY 1, 2),
r AS (SELECT d.motif, t, x1, x2, CASE WHEN t = 3 AND l_partkey % 7 = 0 THEN 0 ELSE ({VALUE.format(t='t')})::DOUBLE END AS y FROM d JOIN (SELECT archetype, motif, l_suppkey AS site FROM d) a USING (archetype, motif) JOIN f ON f.l_suppkey = site AND f.motif = d.motif, (SELECT unnest(range({len(TARGETS)})) AS t)),
m AS (SELECT motif, t, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my FROM r GROUP BY 1, 2),
s AS (SELECT t, sum((x1 - m1) ** 2) AS s11, sum((x2 - m2) ** 2) AS s22, sum((x1 - m1) * (x2 - m2)) AS s12, sum((x1 - m1) * (y - my)) AS s1, sum((x2 - m2) * (y - my)) AS s2 FROM r JOIN m USING (motif, t) GROUP BY 1),
w AS (SELECT t, (s22 * s1 - s12 * s2) / (s11 * s22 - s12 * s12) AS w1, (s11 * s2 - s12 * s1) / (s11 * s22 - s12 * s12) AS w2 FROM s),
b AS (SELECT motif, t, w1, w2, my - w1 * m1 - w2 * m2 AS base FROM m JOIN w USING (t))"""
NAMES = "(" + repr(TARGETS) + ")[t + 1] AS target"


def lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("motif_class", pick(MOTIFS, F.col("l_partkey"))).withColumn(
        "archetype_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


def site_features(spark, sf_dir):
    return lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("site_id"), "motif_class").agg(
        F.count(F.lit(1)).cast("double").alias(FEATURES[0]), (F.sum("l_quantity").cast("double") / F.count(F.lit(1))).alias(FEATURES[1]))


def training_rows(spark, sf_dir):
    d = lines(spark, sf_dir)
    value = {t: F.expr(VALUE.format(t=t)).cast("double") for t in range(len(TARGETS))}
    value[3] = F.when(F.col("l_partkey") % 7 != 0, value[3])
    physics = d.select("archetype_id", "motif_class", *[v.alias(TARGETS[t]) for t, v in value.items()])
    archetypes = d.select("archetype_id", "motif_class", F.col("l_suppkey").alias("site_id"))
    return J.surrogate_matrix(physics, archetypes, site_features(spark, sf_dir))


@query("surrogate_fit", "H6 C21",
       FIT_SQL + f" SELECT {NAMES}, count(*) AS n, round(avg((base + w1 * x1 + w2 * x2 - y) ** 2), 3) AS mse FROM r JOIN b USING (motif, t) GROUP BY t")
def surrogate_fit(spark, sf_dir):
    rows = training_rows(spark, sf_dir)
    errors = S.surrogate_errors(S.fit_surrogate(rows, FEATURES, TARGETS), rows)
    return errors.select("target", "n", F.round("mse", 3).alias("mse"))


@query("surrogate_predictions", "H6",
       FIT_SQL + f""", q AS (SELECT l_suppkey, motif, x1, x2 FROM f UNION ALL SELECT l_suppkey, 'unseen', x1, NULL FROM f WHERE motif = 'polar')
       SELECT l_suppkey AS site_id, q.motif AS motif_class, {NAMES}, round(coalesce(b.base, o.base) + o.w1 * x1 + o.w2 * coalesce(x2, 0), 2) AS value
       FROM q JOIN (SELECT t, w1, w2, sum(base) / {len(MOTIFS) + 1} AS base FROM b GROUP BY 1, 2, 3) o ON true LEFT JOIN b ON b.motif = q.motif AND b.t = o.t""".replace("[t + 1]", "[o.t + 1]"))
def surrogate_predictions(spark, sf_dir):
    model = S.fit_surrogate(training_rows(spark, sf_dir), FEATURES, TARGETS)
    sites = site_features(spark, sf_dir)
    unseen = sites.where("motif_class = 'polar'").withColumn("motif_class", F.lit("unseen")).withColumn(FEATURES[1], F.lit(None).cast("double"))
    made = model.predict(sites.unionByName(unseen))
    values = F.array(*[F.struct(F.lit(t).alias("target"), F.round(F.col(t), 2).alias("value")) for t in TARGETS])
    return made.select("site_id", "motif_class", F.explode(values).alias("v")).select("site_id", "motif_class", "v.target", "v.value")
