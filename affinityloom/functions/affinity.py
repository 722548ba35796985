"""Affinity text parsing, unit conversion, ddG and score transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinityloom.functions.text import as_col, blank_to_null, text
from affinityloom.functions.vocab import DEFAULT_TEMPERATURE_K, GAS_CONSTANT, NANOMOLAR_FACTORS

# Affinity token dialects of the index text and of the binding-site table.
INDEX_TOKEN = r"(?i)(Kd|Ki|IC50)\s*(<=|>=|=|<|>|~)?\s*(\d+(?:\.\d+)?)\s*(fM|pM|nM|uM|mM|M)?"
MUTATION_TOKEN = r"\b[A-Z]\d+[A-Z]\b"


def unit_factor(unit: Column | str) -> Column:
    low = F.lower(text(unit))
    ladder = None
    for name, factor in NANOMOLAR_FACTORS.items():
        ladder = F.when(low == name, F.lit(factor)) if ladder is None else ladder.when(low == name, F.lit(factor))
    return ladder


def relation_prefix(value: Column | str) -> Column:
    raw = text(value)
    return (
        F.when(raw.startswith(">="), ">=").when(raw.startswith("<="), "<=").when(raw.startswith(">"), ">")
        .when(raw.startswith("<"), "<").when(raw.startswith("~"), "approx")
    )


def numeric_text(value: Column | str) -> Column:
    """Number behind a leading relation sign."""
    return F.trim(F.regexp_replace(text(value), r"^[<>~= ]+", "")).try_cast("double")


def parse_affinity(value: Column | str, unit: Column | str) -> Column:
    number = numeric_text(value)
    standard = F.round(number * unit_factor(unit), 6)
    return F.struct(
        number.alias("value"), F.when(number.isNotNull(), blank_to_null(unit)).alias("unit"),
        standard.alias("standardized"), relation_prefix(value).alias("relation"),
        F.when(standard > 0, F.log10(standard)).alias("log10"),
    )


def parse_affinity_token(token: Column | str) -> Column:
    """``Kd=5.0nM`` style token; fields are null when the token has no affinity."""
    t = F.trim(as_col(token))

    def grab(i: int) -> Column:
        return F.nullif(F.regexp_extract(t, INDEX_TOKEN, i), F.lit(""))

    number = grab(3).try_cast("double")
    return F.struct(
        grab(1).alias("kind"), grab(2).alias("relation"), number.alias("value"), grab(4).alias("unit"),
        F.round(number * unit_factor(grab(4)), 6).alias("standardized"),
    )


# Affinity text of the binding-site table.
SITE_TOKEN = r"(?i)(Kd|Ki|IC50|EC50|dG|ΔG)\s*[:=]?\s*([<>~]?\d+(?:\.\d+)?)\s*(fM|pM|nM|uM|mM|M|kcal/mol)?"


def parse_site_affinity(token: Column | str) -> Column:
    """First affinity of a free text such as ``EC50: <3 uM`` or ``ΔG=-7``; a free energy with a unit is its own standard."""
    t = F.trim(as_col(token))
    grab = lambda i: F.nullif(F.regexp_extract(t, SITE_TOKEN, i), F.lit(""))
    kind = F.when(grab(1) == "ΔG", "dG").otherwise(grab(1))
    number = F.regexp_replace(grab(2), "^[<>~]", "").try_cast("double")
    molar = F.round(number * unit_factor(grab(3)), 6)
    return F.struct(
        kind.alias("kind"), number.alias("value"), grab(3).alias("unit"),
        F.coalesce(molar, F.when((kind == "dG") & grab(3).isNotNull(), number)).alias("standardized"))


def ddg(affinity_mut: Column | str, affinity_wt: Column | str, temperature: Column | str,
        explicit: Column | str | None = None) -> Column:
    """Explicit value, else R*T*ln(Kd_mut/Kd_wt) with both positive."""
    kelvin = F.coalesce(text(temperature).try_cast("double"), F.lit(DEFAULT_TEMPERATURE_K))
    mut, wt = numeric_text(affinity_mut), numeric_text(affinity_wt)
    computed = F.when((mut > 0) & (wt > 0), F.round(GAS_CONSTANT * kelvin * F.ln(mut / wt), 6))
    if explicit is None:
        return computed
    return F.coalesce(text(explicit).try_cast("double"), computed)


def celsius(temperature: Column | str) -> Column:
    return F.coalesce(text(temperature).try_cast("double"), F.lit(DEFAULT_TEMPERATURE_K)) - 273.15


def mutation_annotation(*texts: Column | str) -> Column:
    """Sorted distinct mutation tokens; otherwise whether the text says wild type."""
    hay = F.concat_ws(" ", *[as_col(t) for t in texts])
    found = F.sort_array(F.array_distinct(F.regexp_extract_all(hay, F.lit(MUTATION_TOKEN), F.lit(0))))
    low = F.lower(hay)
    wild = low.contains("wild type") | low.contains("wild-type") | low.rlike(r"\bwt\b")
    return F.struct(
        F.when(F.size(found) > 0, F.array_join(found, ",")).alias("mutation"),
        F.when(F.size(found) > 0, "mutant").when(wild, "wildtype").alias("state"),
    )


def activity_type(kind: Column | str) -> Column:
    """Supported activity types; both spellings of a free-energy difference become ``dG``."""
    raw = F.trim(as_col(kind))
    low = F.lower(raw)
    return F.when(low.isin("dg", "δg"), "dG").when(low.isin("kd", "ki", "ic50", "ec50"), raw)


def strength(log10: Column | str) -> Column:
    c = as_col(log10)
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - c / 6.0))).otherwise(0.0)


def confidence_bonus(band: Column | str, conflict: Column) -> Column:
    low = F.lower(text(band))
    base = F.when(low == "high", 0.20).when(low == "medium", 0.10).when(low == "low", -0.05).otherwise(0.0)
    return base - F.when(conflict, 0.10).otherwise(0.0)


def logistic(score: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-as_col(score)))


def binding_call(kd_nm: Column | str) -> Column:
    c = as_col(kd_nm)
    return (
        F.when(c.isNull(), "unknown").when(c <= 1000, "strong_binder_predicted").when(c <= 10000, "binder_predicted")
        .when(c <= 100000, "weak_binder_predicted").otherwise("unlikely_binder")
    )


def free_energy_proxy(log10: Column | str) -> Column:
    return F.round(-1.364 * as_col(log10), 3)
