"""Corpus-wide line dedup that returns per-document keep bitmaps instead of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.llm.common import ascii_lower

BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def text_lines(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                 min_docs: int = 5) -> DataFrame:
    """(id, text_hash, dropped): a map from word number to 64 bits, one set bit for each dropped line.

    A key of at least ``min_chars`` code points held by at least ``min_docs`` ids loses its lines
    in all documents but the largest id. Occurrences are merged by (key, id) first, so one hot key
    is spread over tasks before its partial counts meet. The keeper of a hash is an aggregate, the
    greatest (id, first position), joined back to the lines; the range partitioning and sort act on
    one row per hash and decide nothing. Documents that lose nothing have no row. Words without dropped lines are absent from
    the map. Rows with a null id neither count nor lose lines; rows with equal id and text are one
    document; rows with one id and several texts count once for a key.
    """
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                F.posexplode(text_lines(F.col(text_col))).alias("pos", "line"))
        .select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "text_hash", "pos", F.unhex(F.md5("key")).alias("hash"))
    )
    held = lines.groupBy("hash", "id").agg(F.min("pos").alias("pos"))
    counted = held.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "pos")).alias("last"))
    keepers = (
        counted.where(F.col("n") >= min_docs)
        .select("hash", F.col("last.id").alias("keeper"), F.col("last.pos").alias("keeper_pos"))
        .repartitionByRange("hash")
        .sortWithinPartitions("hash", F.desc("keeper"), "keeper_pos")
    )
    dropped = lines.join(keepers, "hash").where(F.col("id") != F.col("keeper"))
    bits = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    marked = dropped.groupBy("id", "text_hash", F.floor(F.col("pos") / 64).cast("int").alias("word")).agg(
        F.bit_or(bits).alias("bits"))
    return marked.groupBy("id", "text_hash").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped"))


def with_kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40,
                    min_docs: int = 5) -> DataFrame:
    """``docs`` plus ``__lines`` and ``__kept`` (arrays of lines before and after dropping)."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs).select(
        F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("dropped").alias("__dropped"))
    joined = docs.join(
        bitmaps, (F.col(id_col) == F.col("__id")) & (F.xxhash64(F.col(text_col)) == F.col("__hash")), "left")
    lines = joined.withColumn("__lines", text_lines(F.col(text_col)))
    gone = F.expr(
        "filter(__lines, (x, i) -> coalesce(shiftrightunsigned(__dropped[cast(i div 64 as int)], cast(i % 64 as int)) & 1L, 0L) = 0L)")
    kept = F.when(F.col("__dropped").isNull(), F.col("__lines")).otherwise(gone)
    return lines.withColumn("__kept", kept).drop("__id", "__hash", "__dropped")


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    return with_kept_lines(docs).select(
        "doc_id", F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("__kept", "\n").cast("binary"), 256).alias("kept_sha256"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as text; texts that lose no line stay as they are (null too)."""
    kept = with_kept_lines(docs)
    text = F.when(F.size("__kept") == F.size("__lines"), F.col("text")).otherwise(F.array_join("__kept", "\n"))
    return kept.withColumn("text", text).select(*docs.columns)
