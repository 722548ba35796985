"""Structured Streaming forms of the incremental behaviours.

Each stream drains what is available, in bounded file batches, from its checkpoint. Sinks write one
folder per batch, so a repeated batch replaces its own output. Late rows are those behind the
watermark; they are dropped by the stateful operators and counted in the query progress.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from affinityloom.operators.measurements import conflict_columns, source_priority
from affinityloom.operators.ordering import first_rows


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Each file that matches a path pattern once, in bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", keys: Sequence[str] = (),
          order: Sequence[Column] = ()) -> StreamingQuery:
    """Run until no input is left; every batch lands in ``target/batch_id=N``.

    With ``keys`` a batch is reduced to its latest row per key before it is written.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = first_rows(batch, keys, order) if keys else batch
        rows.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    query.awaitTermination()
    return query


def current_rows(spark: SparkSession, target: str, keys: Sequence[str], order: Sequence[Column] = ()) -> DataFrame:
    """Latest row per key over all batches; later batches win unless ``order`` says otherwise."""
    log = spark.read.parquet(target)
    return first_rows(log, keys, [*order, F.col("batch_id").desc()]).drop("batch_id")


def dropped_late_rows(query: StreamingQuery) -> int:
    """Rows behind the watermark, over all batches of a query."""
    total = 0
    for progress in query.recentProgress:
        for op in progress.stateOperators:
            total += op.numRowsDroppedByWatermark
    return total


def running_counters(stream: DataFrame, source: str, status: str) -> DataFrame:
    """Cumulative attempts per (source, status); update mode."""
    return stream.groupBy(source, status).agg(F.count(F.lit(1)).alias("attempts"))


def hourly_counters(stream: DataFrame, event_time: str, source: str, late: str = "2 hours") -> DataFrame:
    """Attempts per source and hour; an hour is final once the watermark has passed it."""
    return (stream.withWatermark(event_time, late).groupBy(F.window(event_time, "1 hour").alias("w"), source)
            .agg(F.count(F.lit(1)).alias("attempts"))
            .select(F.col("w.start").alias("hour"), source, "attempts"))


def distinct_samples(stream: DataFrame, sample_id: str, event_time: str, late: str = "1 day") -> DataFrame:
    """First sight of every sample id within the watermark."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([sample_id])


def running_summary(stream: DataFrame, keys: Sequence[str], source: str, log_value: str) -> DataFrame:
    """Running measurement summary per key: state is counts, sum, extremes and the set of source names."""
    return stream.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("measurement_count"), F.count(log_value).alias("valued_count"),
        F.sum(log_value).alias("log_sum"), F.min(log_value).alias("low"), F.max(log_value).alias("high"),
        F.collect_set(source).alias("sources"))


def finished_summary(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, conflict fields and preferred source from the running state."""
    best = F.array_min(F.transform("sources", lambda s: F.struct(source_priority(s).alias("p"), s.alias("s"))))
    return state.select(
        *keys, "measurement_count", "valued_count", F.round(F.try_divide("log_sum", "valued_count"), 6).alias("mean_log10"),
        *conflict_columns(F.col("valued_count"), F.col("low"), F.col("high")), best["s"].alias("preferred_source"))
