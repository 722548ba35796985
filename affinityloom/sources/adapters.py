"""Source adapters: each source's normaliser under one declared schema, looked up by name.

An adapter says which of its normaliser's columns is which of ``SCHEMA``'s; those it doesn't name are null. What an
adapter names is checked when it is registered, and its columns and their types when it is applied to rows, before
any job runs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.sources import assays as AS

SCHEMA = {
    "sample_id": "string", "entry_id": "string", "accessions": "string", "ligand_id": "string", "kind": "string", "relation": "string",
    "value": "double", "unit": "string", "standardized": "double", "log10": "double", "mutation": "string", "state": "string"}


@dataclass(frozen=True)
class Adapter:
    """``columns`` maps names of ``SCHEMA`` to SQL expressions over what ``normalise`` returns."""

    name: str
    normalise: Callable[[DataFrame], DataFrame]
    columns: Mapping[str, str]


ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    unknown = sorted(set(adapter.columns) - set(SCHEMA))
    if unknown:
        raise ValueError(f"adapter {adapter.name}: no such columns in the schema: {unknown}")
    if adapter.name in ADAPTERS:
        raise ValueError(f"adapter {adapter.name} is registered already")
    ADAPTERS[adapter.name] = adapter
    return adapter


def adapt(name: str, rows: DataFrame) -> DataFrame:
    """Rows of a source as samples: its name in ``source``, then the columns of ``SCHEMA``."""
    if name not in ADAPTERS:
        raise ValueError(f"no adapter {name}; known: {sorted(ADAPTERS)}")
    columns = ADAPTERS[name].columns
    out = ADAPTERS[name].normalise(rows).select(
        F.lit(name).alias("source"), *[(F.expr(columns[c]) if c in columns else F.lit(None).cast(kind)).alias(c) for c, kind in SCHEMA.items()])
    wrong = [f"{f.name} {f.dataType.simpleString()}" for f in out.schema if SCHEMA.get(f.name, "string") != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"adapter {name}: types differ from the schema: {wrong}")
    return out


def adapt_all(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Samples of several sources, one below the other; none given is an error, empty ones are fine."""
    parts = [adapt(name, rows) for name, rows in frames.items()]
    if not parts:
        raise ValueError("no sources given")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole


def own(*names: str, **others: str) -> dict[str, str]:
    return {**{n: n for n in names}, **others}


for _adapter in (
    Adapter("mutation", AS.mutation_rows, own("entry_id", "kind", "mutation", value="ddg", unit="'kcal/mol'")),
    Adapter("index", AS.index_lines, own("entry_id", "kind", "relation", "value", "unit", "standardized")),
    Adapter("site", lambda rows: AS.site_lines(rows, header=AS.has_site_header(rows)), own("entry_id", "ligand_id", "kind", "value", "unit", "standardized", "log10")),
    Adapter("nested", lambda rows: AS.nested_affinities(rows, "entry_id", "payload"),
            own("entry_id", "ligand_id", "kind", "relation", "value", "standardized", "log10", "mutation", accessions="accession")),
    Adapter("bulk", lambda rows: AS.bulk_samples(rows), own("sample_id", "entry_id", "accessions", "kind", "relation", "value", "log10", "mutation", "state", unit="'nM'")),
    Adapter("activity", AS.activity_samples, own("sample_id", "kind", "value", "standardized", "log10", "mutation", "state", accessions="accession", ligand_id="inchikey")),
):
    register(_adapter)
