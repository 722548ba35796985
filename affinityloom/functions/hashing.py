"""md5-prefix hashing: splits, buckets, hashed features and embeddings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from affinityloom.functions.text import as_col, text
from affinityloom.functions.vocab import RESIDUES

PREFIX_MAX = 4294967295.0


def md5_prefix(value: Column) -> Column:
    """First eight hex digits of the md5 as a bigint."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("bigint")


def seeded(value: Column | str, seed: int) -> Column:
    return F.concat(F.lit(f"{seed}:"), as_col(value).cast("string"))


def hash_split(value: Column | str, train: float = 0.70, val: float = 0.15, seed: int = 42) -> Column:
    check_fractions(train, val)
    share = md5_prefix(seeded(value, seed)).cast("double") / F.lit(PREFIX_MAX)
    return F.when(share < train, "train").when(share < train + val, "val").otherwise("test")


def check_fractions(train: float, val: float) -> None:
    if not 0.0 <= train <= 1.0 or not 0.0 <= val <= 1.0 or train + val > 1.0:
        raise ValueError(f"split fractions out of range: train={train}, val={val}")


def fallback_split(value: Column | str) -> Column:
    """Percent bucket 70/15/15."""
    bucket = F.pmod(md5_prefix(as_col(value).cast("string")), F.lit(100))
    return F.when(bucket < 70, "train").when(bucket < 85, "val").otherwise("test")


def hash_bucket(prefix: str, token: Column, bins: int) -> Column:
    number = F.pmod(md5_prefix(F.concat(F.lit(f"{prefix}:"), token)), F.lit(bins))
    return F.concat(F.lit(f"{prefix}.hash_"), F.format_string("%02d", number))


def char_ngrams(value: Column, n: int) -> Column:
    """All character n-grams in order (with repeats), by one overlapping regex pass over the text."""
    return F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def hashed_tokens(prefix: str, value: Column | str, bins: int, ngrams: tuple[int, ...] = (1,)) -> Column:
    """Array of bucket names, one per token: the whole text for (1,), else its n-grams."""
    clean = text(value)
    if ngrams == (1,):
        tokens = F.filter(F.array(clean), lambda x: x != "")
    else:
        tokens = F.concat(*[char_ngrams(clean, n) for n in ngrams])
    return F.transform(tokens, lambda t: hash_bucket(prefix, t, bins))


def residue_fractions(seq: Column | str) -> Column:
    up = F.upper(F.coalesce(as_col(seq), F.lit("")))
    n = F.greatest(F.length(up), F.lit(1))
    return F.array(*[(F.length(up) - F.length(F.replace(up, F.lit(r), F.lit("")))) / n for r in RESIDUES])


def first_byte_bin(value: Column, bins: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(value), 1, 2), 16, 10).cast("int"), F.lit(bins))


def metadata_embedding(fields: list[Column], bins: int = 8) -> Column:
    """Counts of md5-binned non-blank fields, scaled to sum one."""
    keyed = F.transform(
        F.filter(F.array(*[text(f) for f in fields]), lambda x: x != ""), lambda x: first_byte_bin(F.lower(x), bins)
    )
    counts = [
        (F.size(keyed) - F.size(F.array_remove(keyed, F.lit(b)))).cast("double") for b in range(bins)
    ]
    scale = F.greatest(F.size(keyed), F.lit(1))
    return F.array(*[c / scale for c in counts])
