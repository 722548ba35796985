"""Text, list and cast helpers. Blank, null and missing are one state in this domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(as_col(c).cast("string")), F.lit(""))


def text(c: Column | str) -> Column:
    """Trimmed text, null as the empty string."""
    return F.coalesce(F.trim(as_col(c).cast("string")), F.lit(""))


def first_text(*cols: Column | str) -> Column:
    """First non-blank value."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def trimmed_parts(c: Column | str, pattern: str = "[;,]") -> Column:
    parts = F.transform(F.split(F.coalesce(as_col(c).cast("string"), F.lit("")), pattern), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def distinct_parts(c: Column | str, pattern: str = "[;,]") -> Column:
    """Delimited list as an ordered-distinct array."""
    return F.array_distinct(trimmed_parts(c, pattern))


def joined(c: Column | str, separator: str = "; ") -> Column:
    return F.array_join(as_col(c), separator)


def sorted_join(c: Column | str, separator: str = "; ") -> Column:
    return F.array_join(F.sort_array(as_col(c)), separator)


def safe_double(c: Column | str) -> Column:
    return blank_to_null(c).try_cast("double")


def safe_int(c: Column | str) -> Column:
    """Integers arrive as text such as ``3.0``; truncate toward zero."""
    return safe_double(c).try_cast("bigint")


def safe_bool(c: Column | str) -> Column:
    low = F.lower(text(c))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def truthy(c: Column | str) -> Column:
    return F.lower(text(c)).isin("1", "true", "yes", "y")


def sink_text(c: Column | str, kind: str) -> Column:
    """CSV sink text: booleans true/false, lists joined with ``; ``, maps as key-sorted JSON."""
    col = as_col(c)
    if kind == "boolean":
        return F.when(col.isNull(), "").when(col, "true").otherwise("false")
    if kind == "array":
        return F.array_join(F.filter(col.cast("array<string>"), lambda x: x.isNotNull() & (x != "")), "; ")
    if kind == "map":
        ordered = F.map_from_entries(F.sort_array(F.map_entries(col)))
        return F.coalesce(F.to_json(ordered), F.lit(""))
    return F.coalesce(col.cast("string"), F.lit(""))


def site_residue_tokens(c: Column | str) -> Column:
    return F.filter(F.split(text(c), r"[,\s;]+"), lambda x: x != "")


def site_residue_names(c: Column | str) -> Column:
    """First three letters of each residue token, upper case; tokens without letters drop out."""
    letters = F.transform(site_residue_tokens(c), lambda x: F.regexp_replace(x, r"\P{L}", ""))
    return F.transform(F.filter(letters, lambda x: x != ""), lambda x: F.upper(F.substring(x, 1, 3)))


def is_balanced(c: Column | str, opening: str, closing: str) -> Column:
    """Brackets never close early and end at depth zero (running depth over the characters)."""
    steps = F.transform(
        F.filter(F.split(F.coalesce(as_col(c), F.lit("")), ""), lambda x: x.isin(opening, closing)),
        lambda x: F.when(x == opening, 1).otherwise(-1),
    )
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest")),
        lambda s, x: F.struct(
            (s["depth"] + x).alias("depth"), F.least(s["lowest"], s["depth"] + x).alias("lowest")
        ),
    )
    return (walk["depth"] == 0) & (walk["lowest"] >= 0)


# Characters allowed in a one-line ligand string, and the atom tokens it must contain.
LIGAND_ALLOWED = r"^[A-Za-z0-9@+\-\[\]\(\)=#$:/\\.%,]+$"
LIGAND_ATOM = r"(Cl|Br|[BCNOPSFIKH]|[cnops])"


def ligand_input_error(c: Column | str) -> Column:
    """Reason a ligand string is not usable, null when it is."""
    raw = as_col(c)
    value = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+", ""), r"\s+$", "")
    return (
        F.when(value == "", "empty")
        .when(value.rlike(r"[\r\n]"), "multi_line")
        .when(~value.rlike(LIGAND_ALLOWED), "invalid_characters")
        .when(~(is_balanced(value, "(", ")") & is_balanced(value, "[", "]")), "unbalanced")
        .when(~value.rlike(LIGAND_ATOM), "no_atom_token")
    )


def sequence_input_error(c: Column | str) -> Column:
    """FASTA text starts with ``>``; a raw sequence is letters only."""
    value = F.trim(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), "\r", ""))
    return (
        F.when(value == "", "empty")
        .when(~value.startswith(">") & ~value.rlike(r"^\p{L}+$"), "not_a_sequence")
    )
