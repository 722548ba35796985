"""Unified metadata and entry selection over tables derived from orders and line items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.operators import metadata as MD
from affinityloom.plans import domain as D
from affinityloom.plans.registry import query, table
from affinityloom.plans.scalars import pick, sql_pick

LISTS = ["A", "B; A", "", "C,B,X"]


def _domain_sql(name: str, rest: int) -> str:
    return f"""{name} AS (SELECT e, {sql_pick(['A', '', 'B', ''], 'l_partkey')} AS chain, '{name}' || (l_partkey % 20) AS id, ord FROM b WHERE l_suppkey % 5 = {rest}),
{name}l AS (SELECT e, list, string_agg(id, '; ' ORDER BY o) AS ids FROM (SELECT e, list, id, min(row(nth, ord)) AS o FROM {name} JOIN u USING (e, chain) GROUP BY ALL) GROUP BY ALL),
{name}e AS (SELECT e, string_agg(id, '; ' ORDER BY o) AS ids FROM (SELECT e, id, min(ord) AS o FROM {name} WHERE chain = '' GROUP BY ALL) GROUP BY ALL)"""


UNIFIED_SQL = f"""WITH b AS (SELECT *, 'E' || l_orderkey AS e, row(l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ord FROM lineitem),
p AS (SELECT e, 'k' || l_partkey AS pair_key, coalesce(nullif({sql_pick(LISTS, 'l_partkey')}, ''), 'A') AS list, CASE WHEN l_suppkey % 6 = 0 THEN 'U' || l_suppkey || '; U1' ELSE '' END AS acc,
  CASE WHEN l_partkey % 3 = 0 THEN 'own' ELSE '' END AS org FROM b),
c AS (SELECT e, {sql_pick(['A', 'B', 'C'], 'l_linenumber')} AS chain, CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'SEQ' || l_partkey END AS seq, CASE WHEN l_suppkey % 5 = 0 THEN '' ELSE 'U' || l_suppkey END AS a
  FROM b QUALIFY row_number() OVER (PARTITION BY e, chain ORDER BY ord DESC) = 1),
k AS (SELECT DISTINCT e, list, regexp_split_to_array(list, '[,;]') AS parts FROM p),
u AS (SELECT e, list, nth, trim(x) AS chain FROM (SELECT e, list, unnest(parts) AS x, generate_subscripts(parts, 1) AS nth FROM k)),
rs AS (SELECT e, list, first(seq ORDER BY nth) FILTER (seq <> '') AS seq, count(*) FILTER (seq <> '') AS n FROM u JOIN c USING (e, chain) GROUP BY ALL),
ra AS (SELECT e, list, string_agg(a, '; ' ORDER BY nth) AS accs FROM (SELECT e, list, a, min(nth) AS nth FROM u JOIN c USING (e, chain) WHERE a <> '' GROUP BY ALL) GROUP BY ALL),
{_domain_sql('cath', 1)}, {_domain_sql('scop', 2)},
o AS (SELECT 'E' || o_orderkey AS e, 'O' || (o_custkey % 9) AS organisms, o_orderpriority AS method, {sql_pick(['dimer', '', 'monomer'], 'o_orderkey')} AS oligomer FROM orders),
j AS (SELECT p.*, coalesce(nullif(acc, ''), accs, '') AS accessions, coalesce(rs.seq, '') AS seq, coalesce(rs.n, 0) AS n, coalesce(cathl.ids, cathe.ids, '') AS cath_ids, coalesce(scopl.ids, scope.ids, '') AS scop_ids,
  coalesce(nullif(org, ''), organisms, '') AS organism, coalesce(method, '') AS method, coalesce(oligomer, '') AS oligomer
  FROM p LEFT JOIN rs USING (e, list) LEFT JOIN ra USING (e, list) LEFT JOIN cathl USING (e, list) LEFT JOIN scopl USING (e, list) LEFT JOIN cathe USING (e) LEFT JOIN scope USING (e) LEFT JOIN o USING (e))
SELECT e AS entry_id, pair_key, accessions, organism, method, seq AS sequence, n AS sequence_count, cath_ids, scop_ids, coalesce(nullif(cath_ids, ''), nullif(scop_ids, ''), oligomer) AS fold,
  trim(split_part(accessions, ';', 1)) AS accession, coalesce(s_name, '') AS protein_name, CASE WHEN s_suppkey IS NULL THEN '' WHEN s_suppkey % 2 = 0 THEN 'true' ELSE 'false' END AS reviewed,
  coalesce('g' || s_suppkey || '; h' || s_nationkey, '') AS genes, coalesce((100 + s_suppkey)::VARCHAR, '') AS sequence_length
FROM j LEFT JOIN supplier ON 'U' || s_suppkey = trim(split_part(accessions, ';', 1))"""


def metadata_inputs(spark, sf_dir) -> tuple[DataFrame, ...]:
    b = D.base(spark, sf_dir)
    entries = table(spark, sf_dir, "orders").select(
        D.numbered("E", F.col("o_orderkey")).alias("entry_id"), F.col("o_orderkey").alias("ord"), D.numbered("O", F.col("o_custkey") % 9).alias("organisms"),
        F.col("o_orderpriority").alias("method"), F.lit(None).cast("double").alias("resolution"), pick(["dimer", "", "monomer"], F.col("o_orderkey")).alias("oligomer"))
    none = F.lit(None).cast("string")
    assays = b.select(
        "entry_id", "ord", D.numbered("k", F.col("l_partkey")).alias("pair_key"), none.alias("source"), F.col("l_returnflag").alias("kind"),
        F.col("l_extendedprice").alias("value"), none.alias("mean"), pick(LISTS, F.col("l_partkey")).alias("receptor_chains"),
        F.when(F.col("l_suppkey") % 6 == 0, F.concat(D.numbered("U", F.col("l_suppkey")), F.lit("; U1"))).alias("receptor_accessions"),
        F.when(F.col("l_partkey") % 3 == 0, "own").otherwise("").alias("organisms"), *[none.alias(c) for c in ("ligand_types", "interface_types", "mutations")])
    chains = b.select(
        "entry_id", "ord", pick(["A", "B", "C"], F.col("l_linenumber")).alias("chain_id"),
        F.when(F.col("l_partkey") % 4 != 0, D.numbered("SEQ", F.col("l_partkey"))).alias("sequence"),
        F.when(F.col("l_suppkey") % 5 != 0, D.numbered("U", F.col("l_suppkey"))).alias("accession"))
    proteins = table(spark, sf_dir, "supplier").select(
        D.numbered("U", F.col("s_suppkey")).alias("accession"), F.col("s_name").alias("protein_name"),
        F.array(D.numbered("g", F.col("s_suppkey")), D.numbered("h", F.col("s_nationkey"))).alias("genes"),
        (F.col("s_suppkey") % 2 == 0).alias("reviewed"), (F.col("s_suppkey") + 100).alias("length"))
    cath, scop = (b.where(F.col("l_suppkey") % 5 == rest).select(
        "entry_id", pick(["A", "", "B", ""], F.col("l_partkey")).alias("chain_id"), D.numbered(name, F.col("l_partkey") % 20).alias("id"), "ord")
        for name, rest in (("cath", 1), ("scop", 2)))
    return MD.pairs_from_assays(assays, entries), entries, chains, proteins, cath, scop


@query("unified_metadata", "B10 C8 C9", UNIFIED_SQL)
def unified_metadata(spark, sf_dir):
    return MD.unified_metadata(*metadata_inputs(spark, sf_dir)).select(
        "entry_id", "pair_key", "accessions", "organism", "method", "sequence", "sequence_count", "cath_ids", "scop_ids", "fold",
        "accession", "protein_name", "reviewed", "genes", "sequence_length")


@query("selected_entries", "B14",
       """WITH l AS (SELECT 'E' || o_custkey AS id, min(o_orderkey) AS place FROM orders GROUP BY 1), x AS (SELECT 'E' || c_custkey AS id, c_custkey AS place FROM customer),
       t AS (SELECT 'training_set' AS mode, id, row_number() OVER (ORDER BY place, id) - 1 AS position FROM l UNION ALL SELECT 'explicit', id, row_number() OVER (ORDER BY place, id) - 1 FROM x)
       SELECT mode, id AS entry_id, position FROM t UNION ALL SELECT 'preview', id, position FROM t WHERE mode = 'training_set' AND position < 24""")
def selected_entries(spark, sf_dir):
    key = D.numbered(" e", F.col("o_custkey"))
    even = F.col("o_orderkey") % 2 == 0
    listing = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.when(even, key).alias("pdb_id"), F.when(~even, key).alias("structure_id"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), D.numbered("e", F.col("c_custkey")).alias("entry_id"))
    made = {"training_set": MD.select_ids("training_set", training_set=listing), "preview": MD.select_ids("preview", training_set=listing),
            "explicit": MD.select_ids("all", explicit=asked, limit=0)}
    return reduce(DataFrame.unionByName, [df.select(F.lit(m).alias("mode"), "entry_id", F.col("position").cast("long").alias("position")) for m, df in made.items()])


@query("subset_copy", "B14",
       "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def subset_copy(spark, sf_dir):
    plan = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("ord"), D.numbered("e", F.col("o_orderkey")).alias("pdb_id"))
    chosen = MD.select_ids("refresh_plan", refresh_plan=plan)
    return MD.copy_subset(D.base(spark, sf_dir), chosen, "entry_id").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
