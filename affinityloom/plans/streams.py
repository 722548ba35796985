"""Streaming queries over ``events``; each must equal its batch counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.plans.measurements import KEYS, SUMMARY_SQL
from affinityloom.plans.registry import query, table
from affinityloom.sources.scans import scratch_path
from affinityloom.streaming import incremental as I


def event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return I.file_stream(spark, f"{sf_dir}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def paths(spark, name):
    root = scratch_path(spark, name)
    return f"{root}/rows", f"{root}/state"


@query("stream_latest_upsert", "I3",
       "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest_upsert(spark, sf_dir):
    target, state = paths(spark, "upsert")
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    I.drain(event_stream(spark, sf_dir), target, state, "append", ["user_id", "event_type"], order)
    return I.current_rows(spark, target, ["user_id", "event_type"], order).select("user_id", "event_type", "event_id", "value")


@query("stream_running_counters", "I4", "SELECT user_id, event_type, count(*) AS attempts FROM events GROUP BY 1, 2")
def stream_running_counters(spark, sf_dir):
    target, state = paths(spark, "counters")
    I.drain(I.running_counters(event_stream(spark, sf_dir), "user_id", "event_type"), target, state, "update")
    return I.current_rows(spark, target, ["user_id", "event_type"])


@query("stream_hourly_counters", "I4",
       "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS attempts FROM events GROUP BY 1, 2")
def stream_hourly_counters(spark, sf_dir):
    target, state = paths(spark, "hourly")
    I.drain(I.hourly_counters(event_stream(spark, sf_dir), "ts", "event_type", "365 days"), target, state, "update")
    rows = I.current_rows(spark, target, ["hour", "event_type"])
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "event_type", "attempts")


@query("stream_distinct_samples", "I6", "SELECT DISTINCT 's' || event_id AS sample_id FROM events")
def stream_distinct_samples(spark, sf_dir):
    target, state = paths(spark, "distinct")
    ids = event_stream(spark, sf_dir).withColumn("sample_id", F.explode(F.array_repeat(F.concat(F.lit("s"), F.col("event_id").cast("string")), 2)))
    I.drain(I.distinct_samples(ids, "sample_id", "ts", "365 days"), target, state, "append")
    return spark.read.parquet(target).select("sample_id")


@query("stream_running_summary", "I7 D1 D2 D3",
       SUMMARY_SQL + "SELECT user_id, event_type, measurement_count, mean_log10, conflict_flag, conflict_summary, agreement_band, preferred_source FROM s")
def stream_running_summary(spark, sf_dir):
    target, state = paths(spark, "summary")
    n = F.col("event_id") % 5
    names = ["SKEMPI", "PDBbind", "BioLiP", "BindingDB", "ChEMBL"]
    stream = event_stream(spark, sf_dir).select(
        *KEYS, F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int")).alias("source"),
        F.when(F.col("value") > 0, F.log10("value")).alias("log_value"))
    I.drain(I.running_summary(stream, KEYS, "source", "log_value"), target, state, "update")
    done = I.finished_summary(I.current_rows(spark, target, KEYS), KEYS)
    return done.select(*KEYS, "measurement_count", "mean_log10", "conflict_flag", "conflict_summary", "agreement_band", "preferred_source")
