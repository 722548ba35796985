"""All source adapters over rows in each source's own form."""

from __future__ import annotations

from affinityloom.plans import sources as SO
from affinityloom.plans.registry import SQL, query, table
from affinityloom.sources import adapters as AD


def _part(name: str, source: str, rest: str = "", **columns: str) -> str:
    names = ("entry_id", "sample_id", "kind", "relation", "value", "mutation")
    return f"SELECT '{name}' AS source, {', '.join(f'{columns.get(c, 'NULL')} AS {c}' for c in names)} FROM ({SQL[source]}) AS t {rest}"


SAMPLES_SQL = " UNION ALL ".join([
    _part("mutation", "mutation_table_rows", entry_id="entry_id", kind="'ddG'", value="ddg", mutation="mutation"),
    _part("index", "affinity_index_lines", entry_id="entry_id", kind="kind", relation="relation", value="value"),
    _part("site", "binding_site_rows", entry_id="entry_id", kind="kind", value="value"),
    _part("nested", "nested_affinity_rows", entry_id="entry_id", kind="kind", relation="relation", value="value"),
    _part("bulk", "bulk_row_samples_all", entry_id="split_part(sample_id, '_', 3)", sample_id="sample_id", kind="split_part(sample_id, '_', 6)", relation="relation", value="value", mutation="mutation"),
    _part("activity", "activity_samples_all", "JOIN (SELECT 'CHEMBL_A' || event_id AS sid, value FROM events) AS e ON sid = sample_id", sample_id="sample_id", kind="kind", value="e.value", mutation="mutation"),
])


@query("adapted_samples", "U1 A29", SAMPLES_SQL)
def adapted_samples(spark, sf_dir):
    return AD.adapt_all({
        "mutation": SO.mutation_table(spark, sf_dir), "index": SO.index_text(spark, sf_dir), "site": SO.site_text(spark, sf_dir),
        "nested": SO.nested_text(spark, sf_dir), "bulk": SO.bulk_lines(table(spark, sf_dir, "lineitem")),
        "activity": SO.activity_rows(table(spark, sf_dir, "events"))}).select("source", "entry_id", "sample_id", "kind", "relation", "value", "mutation")
