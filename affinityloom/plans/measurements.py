"""Measurement queries over ``events``: key = (user, event type), value and source per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinityloom.functions.hashing import hash_split
from affinityloom.operators import measurements as M
from affinityloom.plans.registry import query, table

KEYS = ["user_id", "event_type"]

MEASUREMENTS_SQL = """
  SELECT event_id, user_id, event_type, value,
         CASE event_id % 5 WHEN 0 THEN 'SKEMPI' WHEN 1 THEN 'PDBbind' WHEN 2 THEN 'BioLiP'
                           WHEN 3 THEN 'BindingDB' ELSE 'ChEMBL' END AS source,
         CASE WHEN value > 0 THEN log10(value) END AS log_value
  FROM events
"""

SUMMARY_SQL = f"""
WITH m AS ({MEASUREMENTS_SQL}),
g AS (
  SELECT user_id, event_type, count(*) AS measurement_count, count(log_value) AS valued_count,
         round(avg(log_value), 6) AS mean_log10, min(log_value) AS lo, max(log_value) AS hi,
         list_sort(list(DISTINCT source)) AS srcs,
         min(CASE source WHEN 'SKEMPI' THEN 1 WHEN 'PDBbind' THEN 2 WHEN 'BioLiP' THEN 3
                         WHEN 'BindingDB' THEN 4 WHEN 'ChEMBL' THEN 5 ELSE 99 END) AS prio,
         arg_min(source, CASE source WHEN 'SKEMPI' THEN 1 WHEN 'PDBbind' THEN 2 WHEN 'BioLiP' THEN 3
                         WHEN 'BindingDB' THEN 4 WHEN 'ChEMBL' THEN 5 ELSE 99 END) AS preferred_source
  FROM m GROUP BY user_id, event_type
),
s AS (
  SELECT user_id, event_type, measurement_count, valued_count, mean_log10,
         coalesce(valued_count >= 2 AND hi - lo >= 0.3, false) AS conflict_flag,
         CASE WHEN valued_count < 2 THEN NULL
              WHEN hi - lo < 0.3 THEN 'agreement_within_0.3_log10'
              WHEN hi - lo < 1.0 THEN printf('moderate_conflict_spread=%.3f', hi - lo)
              ELSE printf('high_conflict_spread=%.3f', hi - lo) END AS conflict_summary,
         CASE WHEN valued_count < 2 THEN NULL WHEN hi - lo < 0.3 THEN 'high'
              WHEN hi - lo < 1.0 THEN 'medium' ELSE 'low' END AS agreement_band,
         array_to_string(srcs, ',') AS sources, preferred_source,
         CASE WHEN len(srcs) = 1 THEN 'single_source:' || preferred_source
              ELSE 'priority_policy:selected=' || preferred_source || ';priority=' || prio
                   || ';candidates=' || array_to_string(srcs, ',') END AS preferred_rationale
  FROM g
)
"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 5
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type", "value",
        F.when(n == 0, "SKEMPI").when(n == 1, "PDBbind").when(n == 2, "BioLiP").when(n == 3, "BindingDB")
        .otherwise("ChEMBL").alias("source"),
        F.when(F.col("value") > 0, F.log10("value")).alias("log_value"),
    )


@query("measurement_group_summary", "D1 D2 D3", SUMMARY_SQL + "SELECT * FROM s")
def measurement_group_summary(spark, sf_dir):
    return M.group_summary(measurements(spark, sf_dir), KEYS, "source", "log_value")


@query("measurement_rows_with_summary", "D1 D2 D3",
       SUMMARY_SQL + """SELECT m.event_id, m.source, s.measurement_count, s.mean_log10, s.agreement_band,
       s.preferred_source FROM m JOIN s USING (user_id, event_type)""")
def measurement_rows_with_summary(spark, sf_dir):
    return M.attach_summary(measurements(spark, sf_dir), KEYS, "source", "log_value").select(
        "event_id", "source", "measurement_count", "mean_log10", "agreement_band", "preferred_source"
    )


@query("measurement_lines", "D1",
       f"""WITH m AS ({MEASUREMENTS_SQL})
       SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS line_number,
              source || ':' || event_type || '=' || CAST(value AS VARCHAR) || ' nM' AS line
       FROM m WHERE value IS NOT NULL""")
def measurement_lines(spark, sf_dir):
    m = measurements(spark, sf_dir).withColumn("unit", F.lit("nM")).withColumn("kind", F.col("event_type"))
    return M.measurement_lines(m, KEYS, "source", "kind", "value", "unit", "event_id")


WINNER_SQL = SUMMARY_SQL + """, w AS (
  SELECT m.*, s.preferred_source, s.measurement_count,
         row_number() OVER (PARTITION BY user_id, event_type ORDER BY
           CASE WHEN m.source = s.preferred_source THEN 1 ELSE 0 END DESC, s.measurement_count DESC,
           m.source DESC, m.event_id) AS rn
  FROM m JOIN s USING (user_id, event_type))
"""


def winners(spark, sf_dir):
    rows = M.attach_summary(measurements(spark, sf_dir), KEYS, "source", "log_value")
    return rows, M.ranked_winners(rows, KEYS, "source", "preferred_source", "measurement_count", "event_id")


@query("ranked_measurement_winner", "E2",
       WINNER_SQL + "SELECT user_id, event_type, event_id, source, value FROM w WHERE rn = 1")
def ranked_measurement_winner(spark, sf_dir):
    return winners(spark, sf_dir)[1].select("user_id", "event_type", "event_id", "source", "value")


@query("measurement_losers", "E2 F7",
       WINNER_SQL + """SELECT event_id, source, 'duplicate_pair_affinity_not_selected' AS reason
       FROM w WHERE rn > 1""")
def measurement_losers(spark, sf_dir):
    rows, won = winners(spark, sf_dir)
    return M.losing_rows(rows, won, "event_id").select("event_id", "source", "reason")


@query("measurement_release_counts", "D1 D2 D3 E2 E17",
       WINNER_SQL + """, split AS (
         SELECT source, value,
           CASE WHEN h < 0.7 THEN 'train' WHEN h < 0.7 + 0.15 THEN 'val' ELSE 'test' END AS split
         FROM (SELECT source, value, CAST(('0x' || substr(md5('42:' || user_id || '|' || event_type), 1, 8)) AS BIGINT)
                 / 4294967295.0::DOUBLE AS h FROM w WHERE rn = 1))
       SELECT split, source, count(*) AS winners,
              CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value
       FROM split GROUP BY split, source""")
def measurement_release_counts(spark, sf_dir):
    """Flagship: conflict-resolved winner per key, hash split, counts per split and source."""
    won = winners(spark, sf_dir)[1]
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.col("event_type"))
    return won.select("source", "value", hash_split(key).alias("split")).groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("winners"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total_value"),
    )


@query("assay_rows_from_samples", "B5",
       f"""WITH m AS ({MEASUREMENTS_SQL})
       SELECT event_id, CASE WHEN event_type = 'dG' THEN value END AS delta_g,
              CASE WHEN event_type = 'ddG' THEN value END AS delta_delta_g,
              event_id % 3 = 0 AS is_mutant_measurement,
              CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS mutation_count,
              CASE WHEN event_id % 3 = 2 THEN 'medium' ELSE 'high' END AS value_confidence,
              CASE WHEN value > 0 THEN 'high' ELSE 'unknown' END AS log_confidence
       FROM (SELECT event_id, value, CASE event_type WHEN 'error' THEN 'ddG' WHEN 'view' THEN 'dG' ELSE event_type END
             AS event_type FROM m)""")
def assay_rows_from_samples(spark, sf_dir):
    n = F.col("event_id") % 3
    samples = measurements(spark, sf_dir).withColumn(
        "kind", F.when(F.col("event_type") == "error", "ddG").when(F.col("event_type") == "view", "dG")
        .otherwise(F.col("event_type"))
    ).withColumn("mutation", F.when(n == 0, F.concat(F.lit("A"), F.col("event_id").cast("string"), F.lit("V")))) \
     .withColumn("state", F.when(n == 0, "mutant").when(n == 1, "wildtype"))
    rows = M.assay_rows(samples, "kind", "value", "log_value", "mutation", "state")
    return rows.select(
        "event_id", "delta_g", "delta_delta_g", "is_mutant_measurement", "mutation_count",
        F.col("field_confidence")["binding_affinity_value"].alias("value_confidence"),
        F.col("field_confidence")["binding_affinity_log10_standardized"].alias("log_confidence"),
    )
