"""Binning ladders, date handling and range predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinityloom.functions.text import as_col

MISSING_DATE = "9999-12-31"


def resolution_bin(res: Column | str) -> Column:
    """Extraction bins; null stays null."""
    c = as_col(res)
    return (
        F.when(c <= 1.5, "high_res_<=1.5").when(c <= 2.5, "medium_res_1.5-2.5").when(c <= 3.5, "low_res_2.5-3.5")
        .when(c.isNotNull(), "very_low_res_>3.5")
    )


def resolution_bucket(res: Column | str) -> Column:
    """Search buckets, a second scheme that coexists with the bins."""
    c = as_col(res)
    return (
        F.when(c.isNull(), "unknown_resolution").when(c <= 2.0, "high_resolution").when(c <= 3.0, "medium_resolution")
        .otherwise("low_resolution")
    )


def sequence_length_band(seq: Column | str) -> Column:
    c = as_col(seq)
    n = F.length(c)
    return (
        F.when(c.isNull() | (c == ""), "seq_unknown").when(n < 150, "seq_short").when(n < 400, "seq_medium")
        .otherwise("seq_long")
    )


def quality_band(score: Column | str) -> Column:
    c = as_col(score)
    return F.when(c >= 0.8, "quality_high").when(c >= 0.55, "quality_medium").otherwise("quality_low")


def release_day(value: Column | str) -> Column:
    """First ten characters of the ISO text; missing sorts last."""
    day = F.substring(as_col(value).cast("string"), 1, 10)
    return F.coalesce(F.nullif(day, F.lit("")), F.lit(MISSING_DATE))


def in_year_range(value: Column | str, low: int | None, high: int | None) -> Column:
    """Year bounds as plain date comparisons so that they push down to the scan."""
    c = as_col(value)
    test = F.lit(True)
    if low is not None:
        test = test & (c >= F.lit(f"{low:04d}-01-01").cast("timestamp_ntz"))
    if high is not None:
        test = test & (c < F.lit(f"{high + 1:04d}-01-01").cast("timestamp_ntz"))
    return test
