"""Secret scan with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.llm.common import scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind, its pattern, the group whose length counts and the least length."""

    kind: str
    pattern: str
    group: int
    least: int


#: The kinds in their listed order.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
RULE_VERSION = 1
SPAN = "array<struct<start:int,kind_no:int,end:int>>"


def _spans(text: str, rule: Rule, number: int) -> Column:
    """Spans of one rule: the gaps between matches and the matches alternate, so their lengths give the places."""
    gaps = F.split(F.col(text), rule.pattern, -1)
    hits = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(F.col(text), F.lit(rule.pattern), F.lit(rule.group))
    parts = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), counted.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"))
        found = F.when(F.length(part["value"]) >= rule.least, F.array(span)).otherwise(F.array().cast(SPAN))
        return F.struct(end.alias("at"), F.concat(acc["spans"], found).alias("spans"))

    return F.when(F.col(text).rlike(rule.pattern), F.aggregate(parts, start, step)["spans"]).otherwise(
        F.array().cast(SPAN))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of (blob, text); spans sorted by start, then kind as listed."""
    spans = F.concat(*[_spans("text", r, i) for i, r in enumerate(rules)])
    return blobs.select("blob", F.array_sort(spans).alias("spans"))


def update_ledger(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, version: int = RULE_VERSION,
                  seen: bool = True) -> DataFrame:
    """Scan the blobs of ``versions`` (path, text) that the ledger lacks for this rule version; return the ledger.

    The ledger is a Parquet folder of (blob, rule_version, spans), clean blobs included. A null text
    is the empty blob. ``seen=False`` starts a new ledger. One path per unseen blob, the smallest,
    supplies the text, so a group of copies is scanned once and its ids are merged before any
    shuffle; repeated rows are merged by the blob.
    """
    spark = versions.sparkSession
    addressed = versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "blob", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    ids = addressed.select("blob", F.coalesce(F.col("path").cast("string"), F.lit("")).alias("key"))
    fresh = ids.groupBy("blob").agg(F.min("key").alias("key"))
    if seen:
        known = spark.read.parquet(ledger).where(F.col("rule_version") == version).select("blob")
        fresh = fresh.join(known, "blob", "left_anti")
    unseen = addressed.withColumn("key", F.coalesce(F.col("path").cast("string"), F.lit(""))).join(
        fresh, ["blob", "key"], "left_semi")
    found = scan(unseen, rules).groupBy("blob").agg(F.first("spans").alias("spans"))
    found.select("blob", F.lit(version).alias("rule_version"), "spans").write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger).where(F.col("rule_version") == version)


def findings_by_path(versions: DataFrame, ledger: DataFrame) -> DataFrame:
    """(path, spans): the ledger's spans joined back to every path; every version keeps its row."""
    addressed = versions.select(
        "path", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("blob"))
    hits = ledger.where(F.size("spans") > 0).select("blob", "spans")
    return addressed.join(hits, "blob", "left").select(
        "path", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))


def secret_digest(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    versions = docs.select(F.col("doc_id").alias("path"), "text")
    ledger = update_ledger(versions, scratch_path(spark, "ledger"), seen=False)
    names = F.array(*[F.lit(r.kind) for r in RULES])
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind_no = {i})) as bigint)").alias(f"n_{r.kind}")
              for i, r in enumerate(RULES)]
    return findings_by_path(versions, ledger).select(
        F.col("path").alias("doc_id"), *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))
