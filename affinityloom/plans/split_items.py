"""Split items with all keys, and the diagnostics of a split over each of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import split_items as SI
from affinityloom.operators import splits as S
from affinityloom.plans import domain as D
from affinityloom.plans.registry import query, table

ITEMS_SQL = f"""WITH {D.DOMAIN_SQL},
    seqs AS (SELECT entry_id, chain_id, 'SEQ' || organism AS sequence FROM chains WHERE organism <> 'O0' QUALIFY row_number() OVER (PARTITION BY entry_id, chain_id ORDER BY ord DESC) = 1),
    accs AS (SELECT entry_id, chain_id, accession FROM chains WHERE accession <> '' QUALIFY row_number() OVER (PARTITION BY entry_id, chain_id ORDER BY ord DESC) = 1),
    pairs AS (SELECT DISTINCT pair_key, entry_id, receptor_key, ligand_key, split_part(pair_key, '|', 5) AS mutation FROM assays),
    named AS (SELECT pair_key, entry_id, unnest(string_split(receptor_key, ',')) AS chain_id FROM pairs WHERE receptor_key <> '-'),
    rec AS (SELECT pair_key, array_to_string(list_sort(list(sequence) FILTER (sequence IS NOT NULL)), '|') AS seq, array_to_string(list_sort(list(DISTINCT accession) FILTER (accession IS NOT NULL)), ',') AS acc
      FROM named LEFT JOIN seqs USING (entry_id, chain_id) LEFT JOIN accs USING (entry_id, chain_id) GROUP BY 1),
    o AS (SELECT 'E' || o_orderkey AS entry_id, CASE WHEN o_orderkey % 9 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS release_date,
      CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_custkey % 20 = 1 THEN 'IPR1' ELSE 'IPR' || (o_custkey % 20) || ',IPR1' END WHEN 1 THEN 'PF' || (o_custkey % 10) ELSE '' END AS family,
      CASE WHEN o_orderkey % 4 > 0 THEN 'R' || (o_custkey % 7) END AS pathway, CASE WHEN o_orderkey % 5 = 0 THEN '3.40' WHEN o_orderkey % 2 = 0 THEN 'dimer' ELSE '' END AS fold FROM orders),
    own AS (SELECT DISTINCT pair_key FROM assays JOIN base USING (entry_id, ord) WHERE l_partkey % 13 = 0),
    x AS (SELECT DISTINCT pair_key, kind, 'X' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS example_id, CASE WHEN l_partkey % 4 > 0 THEN 'K' || (l_partkey % 40) END AS inchikey,
      CASE WHEN l_suppkey % 2 = 0 THEN 'Curated' END AS label_source FROM assays JOIN base USING (entry_id, ord) WHERE l_linenumber = 2 AND kind = 'R'),
    f AS (SELECT p.*, nullif(seq, '') AS seq, coalesce(nullif(acc, ''), nullif(seq, ''), p.entry_id || ':' || p.receptor_key) AS ident, release_date,
        CASE WHEN own.pair_key IS NOT NULL THEN 'IPRX' ELSE coalesce(family, '') END AS family, CASE WHEN own.pair_key IS NULL THEN pathway END AS pathway, CASE WHEN own.pair_key IS NULL THEN coalesce(fold, '') ELSE '' END AS fold
      FROM pairs p LEFT JOIN rec USING (pair_key) LEFT JOIN o USING (entry_id) LEFT JOIN own USING (pair_key)),
    i AS (SELECT coalesce(example_id, a.pair_key || '|' || a.kind) AS item_id, a.pair_key, a.kind, f.seq AS receptor_sequence, ident AS receptor_identity,
        'protein_ligand|' || a.kind || CASE WHEN mutation LIKE 'wt%' THEN '|wildtype' WHEN mutation LIKE 'mutation_unknown%' THEN '|unknown' ELSE '|mutant' END || CASE WHEN f.seq IS NULL THEN '|sequence_unknown' ELSE '|has_sequence' END AS representation_key,
        'protein_ligand|' || ident || '|' || f.ligand_key AS hard_group_key, 'protein_ligand|' || coalesce(inchikey, f.ligand_key) AS scaffold_key,
        'protein_ligand|' || coalesce(nullif(family, ''), ident) AS family_key, CASE WHEN family <> '' THEN 'protein_ligand|' || family ELSE '' END AS domain_group_key,
        CASE WHEN pathway IS NOT NULL THEN 'protein_ligand|' || pathway ELSE '' END AS pathway_group_key, CASE WHEN fold <> '' THEN 'protein_ligand|' || fold ELSE '' END AS fold_group_key,
        'protein_ligand|' || coalesce(nullif(family, ''), ident) || '|' || coalesce(inchikey, f.ligand_key) || '|' || lower(mutation) AS mutation_group_key, 'protein_ligand|' || coalesce(label_source, source) AS source_group_key, release_date
      FROM assays a JOIN f USING (pair_key) LEFT JOIN x ON x.pair_key = a.pair_key AND x.kind = a.kind)
    """


def items(spark, sf_dir):
    none = F.lit(None).cast("string")
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    chains = D.chains(spark, sf_dir).withColumn("sequence", F.when(F.col("organism") != "O0", F.concat(F.lit("SEQ"), F.col("organism"))).otherwise(""))
    entries = o.select(D.numbered("E", key).alias("entry_id"), key.alias("ord"), F.when(key % 9 > 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).otherwise("").alias("release_date"))
    # An assay's order and entry hold the numbers of its line.
    numbered = D.assays(spark, sf_dir).where("entry_id IS NOT NULL").select("*", F.substring("entry_id", 2, 20).alias("l_orderkey"), "ord.l_linenumber", "ord.l_partkey", "ord.l_suppkey")
    per_entry = o.select(
        F.lit("").alias("pair_key"), D.numbered("e", key).alias("entry_id"), key.alias("ord"),
        F.when(key % 3 == 0, F.concat(F.lit("IPR"), (cust % 20).cast("string"), F.lit("; IPR1,IPR1"))).alias("interpro_ids"),
        F.when(key % 3 == 2, " ").otherwise(D.numbered("PF", cust % 10)).alias("pfam_ids"),
        F.when(key % 4 > 0, F.concat(F.lit(" ;R"), (cust % 7).cast("string"), F.lit(";R0"))).alias("pathway_ids"),
        F.when(key % 5 == 0, "3.40").otherwise("").alias("structural_fold"), F.when(key % 2 == 0, "dimer").alias("oligomeric_state"))
    per_pair = numbered.filter("l_partkey % 13 = 0").select(
        "pair_key", F.lit("").alias("entry_id"), F.lit(0).cast("bigint").alias("ord"), F.lit("IPRX").alias("interpro_ids"), F.lit("PFX").alias("pfam_ids"),
        none.alias("pathway_ids"), none.alias("structural_fold"), none.alias("oligomeric_state"))
    examples = numbered.filter("l_linenumber = 2 AND kind = 'R'").select(
        F.concat(F.lit("X"), F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("example_id"), "pair_key", "kind",
        F.when(F.col("l_partkey") % 4 > 0, D.numbered("K", F.col("l_partkey") % 40)).alias("inchikey"), F.lit("").alias("smiles"), none.alias("ligand_id"),
        F.when(F.col("l_suppkey") % 2 == 0, "Curated").alias("label_source"), F.lit(" ").alias("experiment_source")).distinct().withColumn("ord", F.lit(0))
    return SI.pair_split_items(D.assays(spark, sf_dir).withColumn("selected_source", none), chains, entries, examples, per_entry.unionByName(per_pair))


@query("pair_split_items", "B11", f"{ITEMS_SQL} SELECT * FROM i")
def pair_split_items(spark, sf_dir):
    return items(spark, sf_dir)


@query("split_key_breakdown", "B11 D8",
       ITEMS_SQL + f""", s AS (SELECT *, CASE WHEN left(md5(hard_group_key), 1) < 'b' THEN 'train' WHEN left(md5(hard_group_key), 1) < 'd' THEN 'val' ELSE 'test' END AS split FROM i),
       k AS ({' UNION ALL '.join(f"SELECT split, '{k}' AS field, {k} AS group_key FROM s" for k in SI.KEYS)}), n AS (SELECT field, split, group_key, count(*) AS n FROM k WHERE group_key <> '' GROUP BY ALL)
       SELECT field, split, count(*) AS unique_count, max(n) AS largest_group_count FROM n GROUP BY ALL""")
def split_key_breakdown(spark, sf_dir):
    first = F.left(F.md5("hard_group_key"), F.lit(1))
    split = F.when(first < "b", "train").when(first < "d", "val").otherwise("test")
    return S.split_breakdown(items(spark, sf_dir).withColumn("split", split), "split", SI.KEYS).select("field", "split", "unique_count", "largest_group_count")
