"""File scans and sinks. Schemas are declared, never inferred; row order becomes an explicit column."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinityloom.functions.text import blank_to_null, sink_text, text
from affinityloom.operators.ordering import first_rows
from affinityloom.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """Order of rows as filename, then position in the file (a file split keeps its rows in order)."""
    return df.withColumn(name, F.struct(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row")))


def read_json_directory(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.json") -> DataFrame:
    """Every JSON file of a folder, each an object or a list of objects; unreadable files give no rows."""
    marked = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = with_ordinal(spark.read.schema(marked).option("multiLine", True).option("mode", "PERMISSIVE")
                        .option("pathGlobFilter", pattern).json(path))
    return rows.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Header CSV with every value a string and missing values as the empty string."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("sep", sep).option("quote", '"').option(
        "escape", '"').csv(path).na.fill("")


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """CSV with fixed columns: booleans true/false, lists joined, maps as key-sorted JSON."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    df.select(*[sink_text(c, kinds[c]).alias(c) for c in columns]).write.option("header", True).option(
        "quote", '"').option("escape", '"').mode("errorifexists").csv(path)


def write_shards(df: DataFrame, path: str, key: str, per_shard: int = 5000) -> None:
    """Gzip JSON-lines shards of at most ``per_shard`` records, ranges of ``key`` per shard."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", per_shard).option(
        "compression", "gzip").mode("errorifexists").json(path)


def read_shards(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def shard_manifest(shards: DataFrame, key: str) -> DataFrame:
    """First and last id and record count per shard file."""
    return shards.groupBy(F.col("_metadata.file_name").alias("shard")).agg(
        F.min(key).alias("first_id"), F.max(key).alias("last_id"), F.count(F.lit(1)).alias("records"))


def write_splits(df: DataFrame, path: str, split: str) -> None:
    """One folder per split."""
    df.write.partitionBy(split).mode("errorifexists").parquet(path)


def upsert_manifest(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Latest row per key over old and new rows."""
    return first_rows(existing.unionByName(incoming), keys, [F.col(arrival).desc()])


def record_health(df: DataFrame, name: str, raw: str, valid: Column, examples: int = 10) -> DataFrame:
    """Total, valid, empty, corrupt and invalid counts, and the first ``examples`` names per state.

    ``valid`` is a boolean over the parsed text (any column expression).
    """
    state = (F.when(text(raw) == "", "empty").when(F.try_parse_json(F.col(raw)).isNull(), "corrupt")
             .when(~F.coalesce(valid, F.lit(False)), "invalid").otherwise("valid"))
    tagged = df.select(F.col(name).alias("name"), state.alias("state"))
    named = first_k(tagged, "state", "name", examples)
    return tagged.groupBy("state").agg(F.count(F.lit(1)).alias("records")).join(named, "state")


def first_k(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    from affinityloom.operators.ordering import top_rows
    return top_rows(df, [key], [F.col(value)], k).groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list(value)), ",").alias("examples"))


def pending_inputs(inputs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inputs whose identity (id, size, time, parameters) is not in the output manifest yet."""
    return inputs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def stale_inputs(inputs: DataFrame, outputs: DataFrame, keys: Sequence[str], modified: str, valid: str) -> DataFrame:
    """Inputs to be built (again): those without a valid output at least as new as they are.

    An input without a time, or whose outputs have none, is built. Rows with a null key are always built.
    """
    done = outputs.filter(F.col(valid)).groupBy(*keys).agg(F.max(modified).alias("_built"))
    return inputs.join(done.withColumnsRenamed({k: f"_{k}" for k in keys}), [
        *[F.col(k) == F.col(f"_{k}") for k in keys], F.col("_built") >= F.col(modified)], "left_anti")


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Source tables in priority order under one schema, with the source's position."""
    out = None
    for i, (name, df) in enumerate(frames.items()):
        part = df.withColumn("source", F.lit(name)).withColumn("source_ordinal", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def nonblank(c: str) -> Column:
    return blank_to_null(c).isNotNull()
