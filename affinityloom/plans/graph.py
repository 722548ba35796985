"""Graph queries: suppliers as proteins, parts as ligands, lines as interactions."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import graph as G
from affinityloom.plans import domain as D
from affinityloom.plans.registry import query, table
from affinityloom.plans.scalars import pick, sql_pick

EDGE_KINDS = [G.PPI, G.PLI, G.PATHWAY]
GRAPH_SQL = f"""gn AS (SELECT 's' || s_suppkey AS node_id, 'Protein' AS node_type, s_nationkey AS owner FROM supplier
  UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Pathway' ELSE 'Ligand' END, p_partkey % 25 FROM part),
ge AS (SELECT CASE WHEN l_linenumber % 5 = 0 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS source,
  CASE WHEN l_linenumber % 5 = 0 THEN 's' || l_suppkey WHEN l_linenumber % 5 = 1 THEN 's' || (l_suppkey + l_partkey) % 97 ELSE 'p' || l_partkey END AS target,
  {sql_pick(EDGE_KINDS, 'l_linenumber')} AS edge_type FROM lineitem),
gends AS (SELECT source AS node_id, edge_type, target AS other FROM ge UNION ALL SELECT target, edge_type, source FROM ge)"""


def graph_frames(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(
        D.numbered("s", F.col("s_suppkey")).alias("node_id"), F.lit("Protein").alias("node_type"), F.col("s_nationkey").cast("bigint").alias("owner"))
    p = table(spark, sf_dir, "part").select(
        D.numbered("p", F.col("p_partkey")).alias("node_id"), F.when(F.col("p_partkey") % 3 == 0, "Pathway").otherwise("Ligand").alias("node_type"),
        (F.col("p_partkey") % 25).alias("owner"))
    n = F.col("l_linenumber") % 5
    sup, par = D.numbered("s", F.col("l_suppkey")), D.numbered("p", F.col("l_partkey"))
    e = table(spark, sf_dir, "lineitem").select(
        F.when(n == 0, par).otherwise(sup).alias("source"),
        F.when(n == 0, sup).when(n == 1, D.numbered("s", (F.col("l_suppkey") + F.col("l_partkey")) % 97)).otherwise(par).alias("target"),
        pick(EDGE_KINDS, F.col("l_linenumber")).alias("edge_type"))
    return s.unionByName(p), e


def _degree_sql(pathways: str) -> str:
    return f"""WITH {GRAPH_SQL} SELECT n.node_id, coalesce(network_degree, 0) AS network_degree, coalesce(ppi_degree, 0) AS ppi_degree, coalesce(pli_degree, 0) AS pli_degree, coalesce(pathway_count, 0) AS pathway_count FROM (SELECT node_id FROM gn WHERE node_type = 'Protein') n
      LEFT JOIN (SELECT node_id, count(*) AS network_degree, count(*) FILTER (edge_type = '{G.PPI}') AS ppi_degree, count(*) FILTER (edge_type = '{G.PLI}') AS pli_degree FROM gends GROUP BY 1) d USING (node_id)
      LEFT JOIN (SELECT node_id, {pathways} AS pathway_count FROM gends WHERE edge_type = '{G.PATHWAY}' AND other IN (SELECT node_id FROM gn WHERE node_type = 'Pathway') GROUP BY 1) w USING (node_id)"""


@query("degree_features", "D14", _degree_sql("count(DISTINCT other)"))
def degree_features(spark, sf_dir):
    return G.degree_features(*graph_frames(spark, sf_dir))


@query("degree_features_by_edge", "D14 C6", _degree_sql("count(*)"))
def degree_features_by_edge(spark, sf_dir):
    return G.degree_features(*graph_frames(spark, sf_dir), distinct_pathways=False)


SUB_SQL = f"""WITH {GRAPH_SQL}, own AS (SELECT node_id FROM gn WHERE owner IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2)),
kept AS (SELECT * FROM ge WHERE source IN (SELECT node_id FROM own) AND target IN (SELECT node_id FROM own))"""


def subgraph(spark, sf_dir):
    nodes, edges = graph_frames(spark, sf_dir)
    chosen = table(spark, sf_dir, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").cast("bigint").alias("owner"))
    return G.induced_subgraph(nodes, edges, chosen, "owner")


@query("induced_subgraph_edges", "B15", SUB_SQL + " SELECT source, target, edge_type FROM kept")
def induced_subgraph_edges(spark, sf_dir):
    return subgraph(spark, sf_dir)[1].select("source", "target", "edge_type")


@query("induced_subgraph_nodes", "B15", SUB_SQL + " SELECT node_id, node_type FROM gn WHERE node_id IN (SELECT source FROM kept UNION SELECT target FROM kept UNION SELECT node_id FROM own)")
def induced_subgraph_nodes(spark, sf_dir):
    return subgraph(spark, sf_dir)[0].select("node_id", "node_type")


NET_SQL = f"""net AS (SELECT 'N' || l_suppkey AS a, CASE WHEN l_partkey % 40 = 0 THEN '' ELSE 'N' || (l_partkey % 100) END AS b, CAST(l_quantity * 20 AS INT) AS score,
  row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ord FROM lineitem)"""


def network(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        D.numbered("N", F.col("l_suppkey")).alias("a"),
        F.when(F.col("l_partkey") % 40 == 0, "").otherwise(D.numbered("N", F.col("l_partkey") % 100)).alias("b"),
        (F.col("l_quantity") * 20).cast("int").alias("score"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    return G.interaction_network(rows, "a", "b", "score", 400)


@query("interaction_network_edges", "A20",
       f"""WITH {NET_SQL} SELECT 'network:' || least(a, b) || ':' || greatest(a, b) AS edge_id, round(score / 1000.0::DOUBLE, 4) AS evidence, CASE WHEN score >= 900 THEN 'high' ELSE 'medium' END AS confidence
       FROM net WHERE score >= 400 AND b <> '' QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY ord) = 1""")
def interaction_network_edges(spark, sf_dir):
    return network(spark, sf_dir)[1].select("edge_id", "evidence", "confidence")


@query("interaction_network_nodes", "A20", f"WITH {NET_SQL} SELECT DISTINCT 'protein:' || x AS node_id FROM (SELECT a AS x FROM net WHERE score >= 400 AND b <> '' UNION SELECT b FROM net WHERE score >= 400 AND b <> '')")
def interaction_network_nodes(spark, sf_dir):
    return network(spark, sf_dir)[0].select("node_id")


def memberships(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey"), (F.col("l_partkey") % 60).alias("w")).distinct()
    names = F.struct(F.col("w").cast("string").alias("id"), D.numbered("name ", F.col("w")).alias("name"))
    return rows.select(D.numbered("U", F.col("l_suppkey")).alias("accession"), F.array(names).alias("pathways"))


@query("pathway_edges", "A21", "SELECT DISTINCT 'member:U' || l_suppkey || ':' || (l_partkey % 60) AS edge_id, 'protein:U' || l_suppkey AS source, 'pathway:' || (l_partkey % 60) AS target FROM lineitem")
def pathway_edges(spark, sf_dir):
    return G.pathway_edges(memberships(spark, sf_dir))[1].select("edge_id", "source", "target")


@query("pathway_nodes", "A21", "SELECT DISTINCT 'pathway:' || (l_partkey % 60) AS node_id, 'name ' || (l_partkey % 60) AS display_name FROM lineitem")
def pathway_nodes(spark, sf_dir):
    return G.pathway_edges(memberships(spark, sf_dir))[0]


@query("merged_nodes", "F2",
       """WITH e AS (SELECT 0 AS part, 'n' || c_nationkey AS node_id, c_mktsegment AS src, 'cust' AS label FROM customer UNION ALL SELECT 1, 'n' || s_nationkey, 'supplier', 'supp' FROM supplier UNION ALL SELECT 2, 'n' || n_nationkey, 'nation', 'nation' FROM nation)
       SELECT node_id, min_by(label, part) AS label, array_to_string(list_sort(list(DISTINCT src)), ',') AS source_databases FROM e GROUP BY 1""")
def merged_nodes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(D.numbered("n", F.col("c_nationkey")).alias("node_id"), F.col("c_mktsegment").alias("source_database"), F.lit("cust").alias("label"))
    s = table(spark, sf_dir, "supplier").select(D.numbered("n", F.col("s_nationkey")).alias("node_id"), F.lit("supplier").alias("source_database"), F.lit("supp").alias("label"))
    n = table(spark, sf_dir, "nation").select(D.numbered("n", F.col("n_nationkey")).alias("node_id"), F.lit("nation").alias("source_database"), F.lit("nation").alias("label"))
    return G.merge_nodes([c, s, n], ["label"])


@query("merged_edges", "F2 E1",
       """SELECT edge_id, label FROM (SELECT 'e' || o_custkey AS edge_id, 'orders' AS label, 0 AS part FROM orders UNION ALL SELECT 'e' || c_custkey, 'customer', 1 FROM customer) QUALIFY row_number() OVER (PARTITION BY edge_id ORDER BY part) = 1""")
def merged_edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(D.numbered("e", F.col("o_custkey")).alias("edge_id"), F.lit("orders").alias("label"))
    c = table(spark, sf_dir, "customer").select(D.numbered("e", F.col("c_custkey")).alias("edge_id"), F.lit("customer").alias("label"))
    return G.merge_edges([o, c])


def chain_nodes(spark, sf_dir):
    return D.chains(spark, sf_dir).withColumn("node_id", G.protein_node_id(F.col("accession"), F.col("entry_id"), F.col("chain_id")))


def ligand_nodes(spark, sf_dir):
    return D.objects(spark, sf_dir).withColumn("node_id", G.ligand_node_id(F.col("inchikey"), F.col("component_id")))


EDGES_SQL = f"""WITH {D.DOMAIN_SQL},
cn AS (SELECT *, CASE WHEN accession <> '' THEN 'protein:' || accession ELSE 'protein:' || entry_id || ':' || chain_id END AS node_id FROM chains QUALIFY row_number() OVER (PARTITION BY entry_id, chain_id ORDER BY ord DESC) = 1),
ln AS (SELECT *, 'ligand:' || CASE WHEN inchikey <> '' THEN inchikey ELSE component_id END AS node_id FROM objects QUALIFY row_number() OVER (PARTITION BY entry_id, component_id ORDER BY ord DESC) = 1),
fx AS (SELECT entry_id, ord, interface_type, partner, unnest(string_split(chain_key, ',')) AS ca FROM interfaces WHERE chain_key <> ''),
ppi AS (SELECT 'ppi:' || f.entry_id || ':' || a.node_id || ':' || b.node_id AS edge_id, 'ProteinProteinInteraction' AS edge_type FROM fx f JOIN cn a ON a.entry_id = f.entry_id AND a.chain_id = f.ca JOIN cn b ON b.entry_id = f.entry_id AND b.chain_id = 'A' WHERE interface_type = 'O'),
pli AS (SELECT 'pli:' || f.entry_id || ':' || a.node_id || ':' || l.node_id, 'ProteinLigandInteraction' FROM fx f JOIN cn a ON a.entry_id = f.entry_id AND a.chain_id = f.ca JOIN ln l ON l.entry_id = f.entry_id AND l.component_id = f.partner WHERE interface_type <> 'O'),
ax AS (SELECT entry_id, ligand_key, unnest(string_split(receptor_key, ',')) AS ca FROM assays WHERE receptor_key <> '-'),
asy AS (SELECT 'assay:' || f.entry_id || ':' || a.node_id || ':' || l.node_id, 'ProteinLigandInteraction' FROM ax f JOIN cn a ON a.entry_id = f.entry_id AND a.chain_id = f.ca JOIN ln l ON l.entry_id = f.entry_id AND l.component_id = f.ligand_key)"""


@query("projected_graph_edges", "C19", EDGES_SQL + " SELECT * FROM ppi UNION SELECT * FROM pli UNION SELECT * FROM asy")
def projected_graph_edges(spark, sf_dir):
    faces = D.interfaces(spark, sf_dir).select(
        "entry_id", "ord", F.col("chains").alias("chains_a"), F.array(F.lit("A")).alias("chains_b"), "partner",
        F.when(F.col("interface_type") == "O", "protein_protein").otherwise("protein_ligand").alias("interface_type"))
    return G.projected_edges(chain_nodes(spark, sf_dir), ligand_nodes(spark, sf_dir), faces, D.keyed_assays(spark, sf_dir)).select("edge_id", "edge_type")


@query("pair_graph_features", "D14",
       f"""WITH {D.DOMAIN_SQL}, cn AS (SELECT DISTINCT entry_id, chain_id, CASE WHEN accession <> '' THEN 'protein:' || accession ELSE 'protein:' || entry_id || ':' || chain_id END AS node_id FROM chains),
       f AS (SELECT 'protein:U' || s_suppkey AS node_id, s_suppkey % 7 AS network_degree FROM supplier), w AS (SELECT DISTINCT pair_key, a.entry_id, unnest(string_split(receptor_key, ',')) AS c FROM assays a WHERE receptor_key <> '-'),
       n AS (SELECT DISTINCT pair_key, node_id FROM w JOIN cn ON cn.entry_id = w.entry_id AND cn.chain_id = w.c) SELECT pair_key, CAST(sum(network_degree) AS BIGINT) AS network_degree FROM n JOIN f USING (node_id) GROUP BY 1""")
def pair_graph_features(spark, sf_dir):
    f = table(spark, sf_dir, "supplier").select(D.numbered("protein:U", F.col("s_suppkey")).alias("node_id"), (F.col("s_suppkey") % 7).alias("network_degree"))
    return G.pair_graph_features(D.keyed_assays(spark, sf_dir), chain_nodes(spark, sf_dir), f, "pair_key")


@query("graph_context_counts", "D22 C28",
       """SELECT upper(p_type) AS p_type, count(*) FILTER (p_size < 20) AS small, count(*) FILTER (p_size >= 20) AS large FROM part GROUP BY 1""")
def graph_context_counts(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("kind", F.when(F.col("p_size") < 20, "small").otherwise("large"))
    return G.graph_context(p, "kind", "p_type", ["small", "large"])


@query("sample_graph_membership", "C24 C28",
       """SELECT d.doc_id, coalesce(n, 0) AS node_count, coalesce(e, 0) AS edge_count, coalesce(n, 0) > 0 AS has_graph FROM documents d LEFT JOIN (SELECT vec_id AS doc_id, count(*) AS n FROM embeddings GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT user_id AS doc_id, count(*) AS e FROM events GROUP BY 1) USING (doc_id)""")
def sample_graph_membership(spark, sf_dir):
    return G.sample_membership(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")),
                               table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id")), "doc_id")


@query("training_examples", "C6 E1",
       f"""WITH {D.DOMAIN_SQL}, fa AS (SELECT * FROM assays QUALIFY row_number() OVER (PARTITION BY pair_key, kind ORDER BY entry_id, ord) = 1),
       mn AS (SELECT pair_key, kind, round(avg(log_value), 6) AS mean_log FROM assays GROUP BY 1, 2),
       fc AS (SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY entry_id, chain_id ORDER BY ord) = 1),
       rc AS (SELECT * FROM fc QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY chain_id) = 1)
       SELECT fa.pair_key, fa.kind, coalesce(CASE WHEN fa.receptor_key <> '-' THEN coalesce(a.accession, b.accession) END, rc.accession, '') AS accession, e.method,
         coalesce(round(fa.log_value, 6), mn.mean_log) AS label, CASE WHEN fa.log_value IS NOT NULL THEN 'assay' WHEN mn.mean_log IS NOT NULL THEN 'group_mean' ELSE 'none' END AS label_source
       FROM fa LEFT JOIN mn USING (pair_key, kind) LEFT JOIN entries e ON e.entry_id = fa.entry_id LEFT JOIN fc a ON a.entry_id = fa.entry_id AND a.chain_id = 'A' LEFT JOIN fc b ON b.entry_id = fa.entry_id AND b.chain_id = 'B' AND fa.receptor_key = 'A,B'
       LEFT JOIN rc ON rc.entry_id = fa.entry_id""")
def training_examples(spark, sf_dir):
    from affinityloom.operators.examples import assemble_examples
    return assemble_examples(D.keyed_assays(spark, sf_dir), D.entries(spark, sf_dir), D.chains(spark, sf_dir)).select(
        "pair_key", "kind", F.coalesce("accession", F.lit("")).alias("accession"), "method", "label", "label_source")


@query("split_items", "B11 G33",
       f"""WITH {D.DOMAIN_SQL}, fc AS (SELECT * FROM chains QUALIFY row_number() OVER (PARTITION BY entry_id, chain_id ORDER BY ord) = 1),
       p AS (SELECT DISTINCT pair_key, kind, entry_id, receptor_key, ligand_key FROM assays), x AS (SELECT pair_key, kind, unnest(string_split(receptor_key, ',')) AS c, entry_id FROM p WHERE receptor_key <> '-'),
       r AS (SELECT pair_key, kind, array_to_string(list_sort(list(DISTINCT accession) FILTER (accession <> '')), '|') AS acc FROM x LEFT JOIN fc ON fc.entry_id = x.entry_id AND fc.chain_id = x.c GROUP BY 1, 2),
       i AS (SELECT p.*, CASE WHEN coalesce(acc, '') <> '' THEN acc ELSE p.entry_id || ':' || p.receptor_key END AS ident FROM p LEFT JOIN r USING (pair_key, kind))
       SELECT pair_key || '|' || kind AS item_id, ident AS receptor_identity, 'protein_ligand|' || ident || '|' || ligand_key AS hard_group_key, ligand_key AS scaffold_key,
         CASE WHEN pair_key LIKE '%|wt' OR pair_key LIKE '%|wt_or_unspecified' THEN 'wildtype_family' WHEN pair_key LIKE '%mutation_unknown' THEN 'mutation_unknown_family' ELSE 'mutant_family' END AS mutation_family FROM i""")
def split_items_query(spark, sf_dir):
    from affinityloom.operators.examples import split_items
    return split_items(D.keyed_assays(spark, sf_dir), D.chains(spark, sf_dir)).select(
        "item_id", "receptor_identity", "hard_group_key", "scaffold_key", "mutation_family")
