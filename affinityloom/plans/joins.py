"""Join queries over the derived domain tables and the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import joins as J
from affinityloom.plans import domain as D
from affinityloom.plans.registry import query, table
from affinityloom.plans.splits import HASH_SPLIT_SQL

W = f"WITH {D.DOMAIN_SQL}"


@query("bulk_measurement_join", "C1",
       """SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice, c_name, n_name, s_name, p_brand
       FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
       LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey""")
def bulk_measurement_join(spark, sf_dir):
    return order_lines(table(spark, sf_dir, "orders"), spark, sf_dir)


def order_lines(orders, spark, sf_dir):
    orders = orders.select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = J.bulk_measurement_join(
        orders, li, [(cust, "c_custkey"), (nation, "n_nationkey"), (supp, "l_suppkey"), (part, "l_partkey")], "l_orderkey")
    return joined.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "c_name", "n_name", "s_name", "p_brand")


FACES_SQL = """faces AS (
  SELECT a.entry_id, a.receptor_key, a.ligand_key, count(*) AS matching_interface_count,
         array_to_string(list_sort(list(DISTINCT interface_type)), '; ') AS matching_interface_types
  FROM (SELECT DISTINCT entry_id, receptor_key, ligand_key FROM assays) a JOIN interfaces i USING (entry_id)
  WHERE (a.receptor_key = '-' OR i.chain_key = '' OR list_has_any(string_split(a.receptor_key, ','), string_split(i.chain_key, ',')))
    AND (i.partner = '' OR i.partner = a.ligand_key) GROUP BY ALL)"""

MASTER_SQL = W + f""", {FACES_SQL},
recv AS (SELECT a.entry_id, a.receptor_key, array_to_string(list_sort(list(DISTINCT accession) FILTER (accession <> '')), '; ') AS accession,
         array_to_string(list_sort(list(DISTINCT organism)), '; ') AS organism
  FROM (SELECT DISTINCT entry_id, receptor_key FROM assays WHERE receptor_key <> '-') a
  JOIN chains c ON c.entry_id = a.entry_id AND list_contains(string_split(a.receptor_key, ','), c.chain_id) GROUP BY ALL),
lig AS (SELECT a.entry_id, a.ligand_key, array_to_string(list_sort(list(DISTINCT component_type)), '; ') AS component_type
  FROM (SELECT DISTINCT entry_id, ligand_key FROM assays) a JOIN objects o ON o.entry_id = a.entry_id AND a.ligand_key IN (o.component_id, o.component_name, o.inchikey) GROUP BY ALL),
feat AS (SELECT pair_key, count(*) AS feature_count FROM assays WHERE kind = 'A' GROUP BY 1),
master AS (SELECT a.entry_id, a.pair_key, a.kind, a.source, a.value, a.log_value, a.ligand_key, e.method, e.resolution, e.structure_path,
  coalesce(r.accession, '') AS accession, coalesce(r.organism, '') AS organism, coalesce(l.component_type, '') AS component_type,
  coalesce(f.matching_interface_count, 0) AS matching_interface_count, coalesce(f.matching_interface_types, '') AS matching_interface_types,
  coalesce(ft.feature_count, 0) AS feature_count, {HASH_SPLIT_SQL.format(id="(a.pair_key || '|' || a.kind)")} AS split
  FROM assays a LEFT JOIN entries e USING (entry_id) LEFT JOIN recv r ON r.entry_id = a.entry_id AND r.receptor_key = a.receptor_key
  LEFT JOIN lig l ON l.entry_id = a.entry_id AND l.ligand_key = a.ligand_key
  LEFT JOIN faces f ON f.entry_id = a.entry_id AND f.receptor_key = a.receptor_key AND f.ligand_key = a.ligand_key LEFT JOIN feat ft ON ft.pair_key = a.pair_key)"""


def pair_splits(spark, sf_dir):
    from affinityloom.functions.hashing import hash_split
    # Dealt by pair key, as the pair master joins them.
    keys = D.assays(spark, sf_dir).select("pair_key", "kind").repartition("pair_key").distinct()
    return keys.withColumn("split", hash_split(F.concat_ws("|", "pair_key", "kind")))


def pair_master_frame(spark, sf_dir, splits=None):
    a = D.assays(spark, sf_dir)
    return J.pair_master(a, D.entries(spark, sf_dir), D.chains(spark, sf_dir), D.objects(spark, sf_dir),
                         D.interfaces(spark, sf_dir), a.filter("kind = 'A'"), pair_splits(spark, sf_dir) if splits is None else splits)


@query("pair_master", "C2 C4 C5",
       MASTER_SQL + "SELECT entry_id, pair_key, kind, source, value, method, accession, organism, component_type, matching_interface_count, matching_interface_types, feature_count, split FROM master")
def pair_master(spark, sf_dir):
    return pair_master_frame(spark, sf_dir).select(
        "entry_id", "pair_key", "kind", "source", "value", "method", "accession", "organism", "component_type",
        "matching_interface_count", "matching_interface_types", "feature_count", "split")


@query("entry_master", "C3 D12",
       W + """SELECT e.entry_id, e.method, coalesce(c.n, 0) AS chain_rows, coalesce(c.chain_ids, '') AS chain_ids, coalesce(a.n, 0) AS assay_rows, coalesce(a.sources, '') AS sources,
         coalesce(o.n, 0) AS object_rows, coalesce(o.types, '') AS object_types, coalesce(i.n, 0) AS interface_rows FROM entries e
       LEFT JOIN (SELECT entry_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT chain_id)), ',') AS chain_ids FROM chains GROUP BY 1) c USING (entry_id)
       LEFT JOIN (SELECT entry_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM assays GROUP BY 1) a USING (entry_id)
       LEFT JOIN (SELECT entry_id, count(*) AS n, array_to_string(list_sort(list(DISTINCT component_type)), ',') AS types FROM objects GROUP BY 1) o USING (entry_id)
       LEFT JOIN (SELECT entry_id, count(*) AS n FROM interfaces GROUP BY 1) i USING (entry_id)""")
def entry_master(spark, sf_dir):
    n = lambda name: F.count(F.lit(1)).alias(name)
    names = lambda c, name: F.array_join(F.sort_array(F.collect_set(c)), ",").alias(name)
    out = J.entry_master(D.entries(spark, sf_dir).select("entry_id", "method"), [
        (D.chains(spark, sf_dir), [n("chain_rows"), names("chain_id", "chain_ids")]),
        (D.assays(spark, sf_dir), [n("assay_rows"), names("source", "sources")]),
        (D.objects(spark, sf_dir), [n("object_rows"), names("component_type", "object_types")]),
        (D.interfaces(spark, sf_dir), [n("interface_rows")]),
    ], "entry_id")
    return out.na.fill(0).na.fill("")


@query("ligand_any_key_match", "C4",
       W + """, k AS (SELECT entry_id, ord, component_id, component_type, unnest(list_distinct([component_id, inchikey, component_name])) AS key FROM objects),
       b AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY entry_id, key ORDER BY ord) = 1),
       f AS (SELECT * FROM objects QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY ord) = 1)
       SELECT a.pair_key, a.value, coalesce(b.component_id, f.component_id) AS component_id, coalesce(b.component_type, f.component_type) AS component_type, b.key IS NOT NULL AS matched_by_key
       FROM assays a LEFT JOIN b ON b.entry_id = a.entry_id AND b.key = a.ligand_key LEFT JOIN f ON f.entry_id = a.entry_id""")
def ligand_any_key_match(spark, sf_dir):
    return J.match_any_key(D.keyed_assays(spark, sf_dir), D.objects(spark, sf_dir), "entry_id", "ligand_key",
                           ["component_id", "inchikey", "component_name"], "ord", ["component_id", "component_type"],
                           ["pair_key", "value"])


@query("interface_match", "C5", W + f", {FACES_SQL} SELECT entry_id, receptor_key, ligand_key, matching_interface_count, matching_interface_types FROM faces")
def interface_match(spark, sf_dir):
    m = J.interface_matches(D.keyed_assays(spark, sf_dir), D.interfaces(spark, sf_dir), "entry_id", "receptor", "ligand_key",
                            "chains", "partner", "interface_type")
    return m.select("entry_id", F.when(F.size("receptor") == 0, "-").otherwise(F.array_join("receptor", ",")).alias("receptor_key"),
                    "ligand_key", "matching_interface_count", "matching_interface_types")


@query("interface_match_strict", "C5",
       W + """SELECT a.entry_id, a.receptor_key, a.ligand_key, count(*) AS matching_interface_count
       FROM (SELECT DISTINCT entry_id, receptor_key, ligand_key FROM assays) a JOIN interfaces i USING (entry_id)
       WHERE (a.receptor_key = '-' OR (i.chain_key <> '' AND list_has_any(string_split(a.receptor_key, ','), string_split(i.chain_key, ','))))
         AND (i.partner = '' OR i.partner = a.ligand_key) GROUP BY ALL""")
def interface_match_strict(spark, sf_dir):
    m = J.interface_matches(D.keyed_assays(spark, sf_dir), D.interfaces(spark, sf_dir), "entry_id", "receptor", "ligand_key",
                            "chains", "partner", "interface_type", unlisted_matches=False)
    return m.select("entry_id", F.when(F.size("receptor") == 0, "-").otherwise(F.array_join("receptor", ",")).alias("receptor_key"),
                    "ligand_key", "matching_interface_count")


@query("fallback_lookup", "C8",
       """WITH d AS (SELECT 'P' || (p_partkey % 700) AS pair, 'B' || p_brand AS entry, p_type, p_size, p_partkey FROM part),
       one AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY pair ORDER BY p_partkey DESC) = 1),
       two AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY entry ORDER BY p_partkey DESC) = 1),
       r AS (SELECT p_partkey AS row_id, 'P' || p_partkey AS pair, 'B' || p_brand AS entry FROM part)
       SELECT r.row_id, coalesce(one.p_type, two.p_type) AS p_type, CASE WHEN one.pair IS NOT NULL THEN 'pair' WHEN two.entry IS NOT NULL THEN 'entry' ELSE 'none' END AS matched_on
       FROM r LEFT JOIN one ON one.pair = r.pair LEFT JOIN two ON two.entry = r.entry""")
def fallback_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    dims = p.select(F.concat(F.lit("P"), (F.col("p_partkey") % 700).cast("string")).alias("pair"),
                    F.concat(F.lit("B"), F.col("p_brand")).alias("entry"), "p_type", "p_partkey")
    rows = p.select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("pair"),
                    F.concat(F.lit("B"), F.col("p_brand")).alias("entry"))
    return J.fallback_lookup(rows, dims, "pair", "entry", ["p_type"], "p_partkey").select("row_id", "p_type", "matched_on")


@query("split_assignment", "C11",
       W + f""", ex AS (SELECT DISTINCT pair_key, kind FROM assays),
       it AS (SELECT pair_key, kind, md5(pair_key || kind) AS example_id, {HASH_SPLIT_SQL.format(id="(pair_key || '|' || kind)")} AS split FROM ex)
       SELECT pair_key, CASE WHEN left(example_id, 1) < '8' THEN kind WHEN kind = 'N' THEN '' ELSE kind END AS kind, split FROM it""")
def split_assignment(spark, sf_dir):
    ex = pair_splits(spark, sf_dir).withColumn("example_id", F.md5(F.concat("pair_key", "kind")))
    kind = F.when(F.col("kind") == "N", "assay_unknown").otherwise(F.col("kind"))
    items = ex.select(F.when(F.substring("example_id", 1, 1) < "8", F.col("example_id"))
                      .otherwise(F.concat_ws("|", "pair_key", kind)).alias("item_id"), "split")
    return J.split_assignment(items, "item_id", ex.select("example_id", "pair_key", "kind"))


@query("chain_context", "C10",
       W + """, s AS (SELECT l_orderkey * 1000 + l_linenumber AS x, entry_id, l_suppkey, ord FROM base), w AS (SELECT entry_id, ord, 'U' || l_suppkey AS accession FROM s),
       f AS (SELECT w.entry_id, w.ord, array_to_string(list_sort(list(DISTINCT c.chain_id)), ',') AS chain_ids FROM w JOIN chains c ON c.entry_id = w.entry_id AND c.accession = w.accession GROUP BY ALL)
       SELECT md5(concat_ws('|', w.entry_id, w.accession, (w.ord)[1], (w.ord)[2])) AS sample_id, coalesce(f.chain_ids, '') AS chain_ids FROM w LEFT JOIN f ON f.entry_id = w.entry_id AND f.ord = w.ord""")
def chain_context(spark, sf_dir):
    accession = D.numbered("U", F.col("l_suppkey"))
    samples = D.base(spark, sf_dir).select(
        F.md5(F.concat_ws("|", "entry_id", accession, F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))).alias("sample_id"),
        "entry_id", F.array(accession).alias("accessions"))
    out = J.chain_context(samples, D.chains(spark, sf_dir), "sample_id", "entry_id", "accessions")
    return out.select("sample_id", F.coalesce(F.array_join("chain_ids", ","), F.lit("")).alias("chain_ids"))


@query("annotation_join", "C9",
       """WITH ann AS (SELECT p_brand AS entry, list_sort(list(DISTINCT p_type)) AS ids, list_sort(list(DISTINCT p_type) FILTER (p_size % 2 = 0)) AS even_ids FROM part GROUP BY 1)
       SELECT p.p_partkey, s.s_name, n.n_name, array_to_string(CASE WHEN p.p_size % 2 = 0 AND even_ids IS NOT NULL THEN even_ids ELSE ids END, ';') AS folds
       FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey % 50 LEFT JOIN nation n ON n.n_nationkey = p.p_partkey % 50 LEFT JOIN ann ON ann.entry = p.p_brand""")
def annotation_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    rows = p.select("p_partkey", (F.col("p_partkey") % 50).alias("accession"), F.col("p_brand").alias("entry"),
                    (F.col("p_size") % 2).cast("string").alias("chain"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("accession"), "s_name")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("accession"), "n_name")
    ids = p.groupBy(F.col("p_brand").alias("entry")).agg(
        F.sort_array(F.collect_set("p_type")).alias("ids"),
        F.sort_array(F.collect_set(F.when(F.col("p_size") % 2 == 0, F.col("p_type")))).alias("even"))
    folds = ids.select("entry", "ids", F.when(F.size("even") > 0, F.create_map(F.lit("0"), F.col("even"))).alias("chain_map"))
    return J.annotation_join(rows, [supp, nation], [(folds, "folds")], "accession", "entry", "chain").select(
        "p_partkey", "s_name", "n_name", F.array_join("folds", ";").alias("folds"))


@query("tool_result_merge", "C22",
       """WITH a AS (SELECT o_custkey AS k, o_totalprice AS x FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1),
       b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 0.0::DOUBLE ELSE c_acctbal END AS y FROM customer),
       c AS (SELECT s_suppkey * 20 AS k, s_acctbal AS z FROM supplier)
       SELECT k, coalesce(nullif(y, 0), nullif(x, 0)) AS energy, nullif(z, 0) AS charge,
         CASE WHEN coalesce(nullif(y, 0), nullif(x, 0)) IS NOT NULL AND nullif(z, 0) IS NOT NULL THEN 'complete'
              WHEN coalesce(nullif(y, 0), nullif(x, 0)) IS NULL AND nullif(z, 0) IS NULL THEN 'rejected' ELSE 'partial' END AS quality
       FROM a FULL JOIN b USING (k) FULL JOIN c USING (k)""")
def tool_result_merge(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("x"), F.col("o_orderkey").alias("ordinal"))
    b = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 == 0, 0.0).otherwise(F.col("c_acctbal")).alias("y"), F.col("c_custkey").alias("ordinal"))
    c = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 20).alias("k"), F.col("s_acctbal").alias("z"), F.col("s_suppkey").alias("ordinal"))
    return J.tool_merge([a, b, c], ["k"], {"energy": ["y", "x"], "charge": ["z"]}, "ordinal")


@query("refresh_plan", "C25",
       """SELECT l_partkey, count(*) AS selected_rows, concat_ws(',', CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10) THEN 'raw' END,
           CASE WHEN l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand <> 'Brand#1') THEN 'structure' END) AS missing_assets,
         CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10 AND p_brand <> 'Brand#1') THEN 'normal' ELSE 'high' END AS priority
       FROM lineitem GROUP BY l_partkey""")
def refresh_plan(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("l_partkey", F.col("p_partkey"))
    return J.refresh_plan(table(spark, sf_dir, "lineitem").select("l_partkey"), "l_partkey",
                          {"raw": p.filter("p_size > 10"), "structure": p.filter("p_brand <> 'Brand#1'")})


@query("identity_crosswalk", "C26 D13",
       W + """, pairs AS (SELECT DISTINCT pair_key, entry_id, receptor_key, ligand_key FROM assays),
       lastc AS (SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY entry_id, chain_id ORDER BY ord DESC) = 1),
       x AS (SELECT DISTINCT pair_key, entry_id, unnest(string_split(receptor_key, ',')) AS chain_id FROM pairs WHERE receptor_key <> '-'),
       pr AS (SELECT x.pair_key, array_to_string(list_sort(list(DISTINCT CASE WHEN coalesce(c.accession, '') <> '' THEN 'protein:' || c.accession ELSE 'protein:' || x.entry_id || ':' || x.chain_id END)), '; ') AS protein_ids,
              bool_and(coalesce(c.accession, '') <> '') AS pe, bool_or(c.ord IS NOT NULL) AS anyp FROM x LEFT JOIN lastc c ON c.entry_id = x.entry_id AND c.chain_id = x.chain_id GROUP BY 1),
       k AS (SELECT entry_id, ord, component_id, inchikey, unnest(list_distinct([component_id, inchikey, component_name])) AS key FROM objects),
       b AS (SELECT * FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY entry_id, key ORDER BY ord) = 1),
       lg AS (SELECT p.pair_key, CASE WHEN b.key IS NULL THEN 'ligand:' || p.ligand_key WHEN b.inchikey <> '' THEN 'ligand:' || b.inchikey ELSE 'ligand:' || b.component_id END AS ligand_id,
              b.key IS NOT NULL AND b.inchikey <> '' AS le FROM pairs p LEFT JOIN b ON b.entry_id = p.entry_id AND b.key = p.ligand_key)
       SELECT p.pair_key, pr.protein_ids, lg.ligand_id, CASE WHEN coalesce(pe, false) AND coalesce(le, true) THEN 'exact' WHEN coalesce(anyp, false) OR ligand_id IS NOT NULL THEN 'partial' ELSE 'unresolved' END AS status
       FROM (SELECT DISTINCT pair_key FROM pairs) p LEFT JOIN pr USING (pair_key) LEFT JOIN lg USING (pair_key)""")
def identity_crosswalk(spark, sf_dir):
    return J.identity_crosswalk(D.keyed_assays(spark, sf_dir), D.chains(spark, sf_dir), D.objects(spark, sf_dir))


@query("identifier_map", "C27",
       """WITH m AS (SELECT CAST(l_partkey % 900 AS VARCHAR) AS source_id, (['uniprot', 'entrez', 'ensembl'])[CAST(l_suppkey % 3 AS INT) + 1] AS target_type, 'T' || (l_suppkey // 50) AS target_id FROM lineitem),
       per AS (SELECT source_id, target_type, count(DISTINCT target_id) AS n, min(target_id) AS best FROM m GROUP BY 1, 2),
       wide AS (SELECT source_id, max(best) FILTER (target_type = 'uniprot') AS uniprot, max(best) FILTER (target_type = 'entrez') AS entrez, max(best) FILTER (target_type = 'ensembl') AS ensembl, max(n) AS most, count(*) AS kinds FROM per GROUP BY 1)
       SELECT CAST(p_partkey AS VARCHAR) AS identifier, 'entrez' AS identifier_type, uniprot, entrez, ensembl,
         CASE WHEN kinds IS NULL THEN 'unmapped' WHEN most > 1 THEN 'ambiguous' WHEN kinds < 3 THEN 'partial' ELSE 'mapped' END AS status
       FROM part LEFT JOIN wide ON source_id = CAST(p_partkey AS VARCHAR)""")
def identifier_map(spark, sf_dir):
    return mapped_parts(table(spark, sf_dir, "lineitem"), spark, sf_dir)


def mapped_parts(lines, spark, sf_dir):
    m = lines.select(
        (F.col("l_partkey") % 900).cast("string").alias("source_id"),
        D.pick(["uniprot", "entrez", "ensembl"], F.col("l_suppkey")).alias("target_type"),
        D.numbered("T", F.floor(F.col("l_suppkey") / 50)).alias("target_id"))
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("identifier"))
    return J.identifier_map(ids, "identifier", m)


@query("pair_backfill", "C31",
       """WITH r AS (SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b, o_orderpriority AS c, o_orderkey % 3 AS d, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'own' END AS note FROM orders),
       n AS (SELECT o_custkey AS a, o_orderstatus AS b, o_orderpriority AS c, o_orderkey % 2 AS d, 'd' || o_orderkey AS note, o_orderkey AS x FROM orders WHERE o_orderkey % 5 = 0),
       e AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY a, b, c, d ORDER BY x DESC) = 1), l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY x) = 1)
       SELECT r.o_orderkey, coalesce(nullif(r.note, ''), e.note, l.note) AS note FROM r LEFT JOIN e ON (e.a, e.b, e.c, e.d) = (r.a, r.b, r.c, r.d) LEFT JOIN l ON (l.a, l.b, l.c) = (r.a, r.b, r.c)""")
def pair_backfill(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    keys = [F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_orderpriority").alias("c")]
    rows = o.select("o_orderkey", *keys, (F.col("o_orderkey") % 3).alias("d"),
                    F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("own").alias("note"))
    donors = o.filter("o_orderkey % 5 = 0").select(*keys, (F.col("o_orderkey") % 2).alias("d"),
                                                   D.numbered("d", F.col("o_orderkey")).alias("note"), F.col("o_orderkey").alias("x"))
    return J.backfill_pairs(rows, donors, ["a", "b", "c", "d"], ["note"], "x").select("o_orderkey", "note")


@query("surrogate_matrix", "C21",
       """SELECT o_orderkey, c_custkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey AND c_mktsegment = (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[CAST(o_orderkey % 5 AS INT) + 1]
       JOIN nation ON n_nationkey = c_nationkey""")
def surrogate_matrix(spark, sf_dir):
    seg = D.pick(["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], F.col("o_orderkey"))
    targets = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("archetype_id"), seg.alias("motif_class"))
    arch = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("archetype_id"), F.col("c_mktsegment").alias("motif_class"),
                                                   F.col("c_nationkey").alias("site_id"))
    segs = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("motif_class"), F.col("c_nationkey").alias("site_id")).distinct()
    feats = segs.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site_id"), "n_name"), "site_id")
    return J.surrogate_matrix(targets, arch, feats).select("o_orderkey", F.col("archetype_id").alias("c_custkey"), "n_name")


@query("training_payload", "C29",
       """SELECT d.doc_id, l.quality, CASE WHEN d.doc_id % 6 = 5 THEN 'unassigned' ELSE (['train', 'val', 'test'])[CAST(d.doc_id % 3 AS INT) + 1] END AS split FROM documents d LEFT JOIN labels l USING (doc_id)""")
def training_payload(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), "quality")
    n = F.col("doc_id")
    splits = table(spark, sf_dir, "documents").filter("doc_id % 6 <> 5").select(
        F.when(n % 2 == 0, F.concat(F.lit("RCSB_"), n.cast("string"))).otherwise(n.cast("string")).alias("member_id"),
        D.pick(["train", "val", "test"], n).alias("split"))
    return J.training_payload(docs, labels, splits, "key", "quality").select(F.col("key").cast("bigint").alias("doc_id"), "quality", "split")


@query("analysis_queue_fragments", "C30",
       """SELECT s_suppkey, pos - 1 AS position, k AS p_partkey, p_name FROM (SELECT s_suppkey, unnest([s_suppkey, s_suppkey + 7, s_suppkey * 3]) AS k, unnest([1, 2, 3]) AS pos FROM supplier) JOIN part ON p_partkey = k""")
def analysis_queue_fragments(spark, sf_dir):
    q = table(spark, sf_dir, "supplier").select("s_suppkey", F.array(F.col("s_suppkey"), F.col("s_suppkey") + 7, F.col("s_suppkey") * 3).alias("ids"))
    return J.token_queue(q, "ids", ["s_suppkey"], table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
