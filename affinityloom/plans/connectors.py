"""The graph of all enabled connectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from affinityloom.operators import connectors as C
from affinityloom.plans import domain as D
from affinityloom.plans import graph as P
from affinityloom.plans.registry import query, table


def connected(spark, sf_dir):
    """Scored pairs of suppliers and the pathways they are members of; both name proteins with N."""
    scored = table(spark, sf_dir, "lineitem").select(
        D.numbered("N", F.col("l_suppkey")).alias("a"),
        F.when(F.col("l_partkey") % 40 == 0, "").otherwise(D.numbered("N", F.col("l_partkey") % 100)).alias("b"),
        (F.col("l_quantity") * 20).cast("int").alias("score"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"))
    members = P.memberships(spark, sf_dir).withColumn("accession", F.regexp_replace("accession", "^U", "N"))
    return C.connected_graph({"pathways": members, "network": scored})


@query("connected_nodes", "U2 F2",
       f"""WITH {P.NET_SQL}, k AS (SELECT * FROM net WHERE score >= 400 AND b <> ''), n AS (SELECT DISTINCT 'protein:' || x AS node_id FROM (SELECT a AS x FROM k UNION SELECT b FROM k)),
       m AS (SELECT DISTINCT 'protein:N' || l_suppkey AS node_id, 'N' || l_suppkey AS shown FROM lineitem)
       SELECT coalesce(n.node_id, m.node_id) AS node_id, 'Protein' AS node_type, CASE WHEN n.node_id IS NULL THEN shown END AS display_name,
         CASE WHEN m.node_id IS NULL THEN 'network' WHEN n.node_id IS NULL THEN 'pathways' ELSE 'network,pathways' END AS source_databases FROM n FULL JOIN m ON m.node_id = n.node_id
       UNION ALL SELECT DISTINCT 'pathway:' || (l_partkey % 60), 'Pathway', 'name ' || (l_partkey % 60), 'pathways' FROM lineitem""")
def connected_nodes(spark, sf_dir):
    return connected(spark, sf_dir)[0].select("node_id", "node_type", "display_name", "source_databases")


@query("connected_edges", "U2 F2",
       f"""WITH {P.NET_SQL}, k AS (SELECT *, least(a, b) AS lo, greatest(a, b) AS hi FROM net WHERE score >= 400 AND b <> '' QUALIFY row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY ord) = 1)
       SELECT 'network:' || lo || ':' || hi AS edge_id, 'ProteinProteinInteraction' AS edge_type, 'protein:' || lo AS source, 'protein:' || hi AS target, round(score / 1000.0::DOUBLE, 4) AS evidence,
         CASE WHEN score >= 900 THEN 'high' ELSE 'medium' END AS confidence, 'network' AS source_database FROM k
       UNION ALL SELECT DISTINCT 'member:N' || l_suppkey || ':' || (l_partkey % 60), 'ProteinPathway', 'protein:N' || l_suppkey, 'pathway:' || (l_partkey % 60), NULL, 'high', 'pathways' FROM lineitem""")
def connected_edges(spark, sf_dir):
    return connected(spark, sf_dir)[1].select("edge_id", "edge_type", "source", "target", "evidence", "confidence", "source_database")
