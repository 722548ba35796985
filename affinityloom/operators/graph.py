"""Interaction graph: node and edge projection, merge, degrees, induced subgraphs, graph samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinityloom.functions.text import first_text, text
from affinityloom.operators.ordering import first_rows

PPI, PLI, PATHWAY = "ProteinProteinInteraction", "ProteinLigandInteraction", "ProteinPathway"


def protein_node_id(accession: Column, entry: Column, chain: Column) -> Column:
    return F.when(text(accession) != "", F.concat(F.lit("protein:"), accession)).otherwise(
        F.concat(F.lit("protein:"), entry, F.lit(":"), chain))


def ligand_node_id(*keys: Column) -> Column:
    return F.concat(F.lit("ligand:"), F.coalesce(first_text(*keys), F.lit("unknown")))


def projected_edges(chains: DataFrame, ligands: DataFrame, interfaces: DataFrame, assays: DataFrame) -> DataFrame:
    """Edges from interfaces (chains x chains, chains x ligand) and assays (receptor chains x ligand).

    Frames are keyed by entry_id; chains and ligands carry node_id. The first row wins per edge id.
    """
    chain_nodes = first_rows(chains, ["entry_id", "chain_id"], [F.col("ord").desc()]).select("entry_id", "chain_id", "node_id")
    ligand_nodes = first_rows(ligands, ["entry_id", "component_id"], [F.col("ord").desc()]).select(
        "entry_id", "component_id", F.col("node_id").alias("target"))

    def at(tag: str) -> DataFrame:
        return chain_nodes.select("entry_id", F.col("chain_id").alias(f"_{tag}"), F.col("node_id").alias(tag))

    faces = interfaces.filter(F.col("interface_type") == "protein_protein").select(
        "entry_id", "ord", F.explode("chains_a").alias("_source"), "chains_b").select(
        "entry_id", "ord", "_source", F.explode("chains_b").alias("_target"))
    ppi = faces.join(at("source"), ["entry_id", "_source"]).join(at("target"), ["entry_id", "_target"]).select(
        F.concat_ws(":", F.lit("ppi"), "entry_id", "source", "target").alias("edge_id"), F.lit(PPI).alias("edge_type"),
        "source", "target", F.lit(0).alias("_layer"), "ord")
    sites = interfaces.filter(F.col("interface_type") != "protein_protein").select(
        "entry_id", "ord", F.explode("chains_a").alias("_source"), F.col("partner").alias("component_id"))
    bound = assays.select("entry_id", "ord", F.explode("receptor").alias("_source"), F.col("ligand_key").alias("component_id"))

    def to_ligand(rows: DataFrame, prefix: str, layer: int) -> DataFrame:
        return rows.join(at("source"), ["entry_id", "_source"]).join(ligand_nodes, ["entry_id", "component_id"]).select(
            F.concat_ws(":", F.lit(prefix), "entry_id", "source", "target").alias("edge_id"), F.lit(PLI).alias("edge_type"),
            "source", "target", F.lit(layer).alias("_layer"), "ord")

    every = ppi.unionByName(to_ligand(sites, "pli", 1)).unionByName(to_ligand(bound, "assay", 2))
    return first_rows(every, ["edge_id"], ["_layer", "ord"]).drop("_layer", "ord")


def interaction_network(rows: DataFrame, a: str, b: str, score: str, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Scored pairs to nodes and undirected edges: low scores dropped, ends sorted, first row per edge id.

    ``rows`` carries an ``ord`` column.
    """
    kept = rows.filter((F.coalesce(F.col(score), F.lit(0)) >= threshold) & (text(a) != "") & (text(b) != ""))
    nodes = kept.select(F.explode(F.array(a, b)).alias("name")).distinct().select(
        F.concat(F.lit("protein:"), F.col("name")).alias("node_id"), F.lit("Protein").alias("node_type"))
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    # The id holds both ends, so rows are sorted with nothing beside it but their score, order and where the first end stops.
    first = first_rows(kept.select(F.concat_ws(":", F.lit("network"), lo, hi).alias("edge_id"), F.length(lo).alias("_size"), F.col(score).alias("_score"), "ord"),
                       ["edge_id"], ["ord"])
    begin = len("network:") + 1
    edges = first.select(
        "edge_id", F.concat(F.lit("protein:"), F.substr("edge_id", F.lit(begin), F.col("_size"))).alias("source"),
        F.concat(F.lit("protein:"), F.substr("edge_id", F.col("_size") + begin + 1)).alias("target"),
        F.round(F.col("_score") / 1000.0, 4).alias("evidence"), F.when(F.col("_score") >= 900, "high").otherwise("medium").alias("confidence"))
    return nodes, edges


def pathway_edges(memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pathway nodes and protein-pathway edges from (accession, pathways array of (id, name))."""
    flat = memberships.select("accession", F.explode("pathways").alias("p"))
    nodes = flat.groupBy(F.concat(F.lit("pathway:"), F.col("p.id")).alias("node_id")).agg(F.min("p.name").alias("display_name"))
    edges = flat.select("accession", F.col("p.id").alias("id")).distinct().select(
        F.concat_ws(":", F.lit("member"), "accession", "id").alias("edge_id"), F.lit(PATHWAY).alias("edge_type"),
        F.concat(F.lit("protein:"), F.col("accession")).alias("source"), F.concat(F.lit("pathway:"), F.col("id")).alias("target"))
    return nodes, edges


def merge_nodes(parts: Sequence[DataFrame], payload: Sequence[str]) -> DataFrame:
    """Nodes by id: first part's payload wins, source names united (a small vocabulary)."""
    every = None
    for i, p in enumerate(parts):
        tagged = p.withColumn("_part", F.lit(i))
        every = tagged if every is None else every.unionByName(tagged)
    return every.groupBy("node_id").agg(
        *[F.min(F.struct("_part", c))[c].alias(c) for c in payload],
        F.array_join(F.sort_array(F.collect_set("source_database")), ",").alias("source_databases"))


def merge_edges(parts: Sequence[DataFrame]) -> DataFrame:
    every = None
    for i, p in enumerate(parts):
        tagged = p.withColumn("_part", F.lit(i))
        every = tagged if every is None else every.unionByName(tagged)
    return first_rows(every, ["edge_id"], ["_part"]).drop("_part")


def edge_ends(edges: DataFrame) -> DataFrame:
    """(node, edge_type, other): each edge from both ends; a self loop counts twice."""
    return edges.select(F.inline(F.array(
        F.struct(F.col("source").alias("node_id"), F.col("edge_type"), F.col("target").alias("other")),
        F.struct(F.col("target").alias("node_id"), F.col("edge_type"), F.col("source").alias("other")))))


def degree_features(nodes: DataFrame, edges: DataFrame, distinct_pathways: bool = True) -> DataFrame:
    """Total, protein-protein and protein-ligand degree and pathway count per protein node, zero-filled.

    ``distinct_pathways`` counts different pathways; otherwise pathway edges.
    """
    ends = edge_ends(edges)
    degree = ends.groupBy("node_id").agg(
        F.count(F.lit(1)).alias("network_degree"), F.count_if(F.col("edge_type") == PPI).alias("ppi_degree"),
        F.count_if(F.col("edge_type") == PLI).alias("pli_degree"))
    member = ends.filter(F.col("edge_type") == PATHWAY).join(
        nodes.filter(F.col("node_type") == "Pathway").select(F.col("node_id").alias("other")), "other", "left_semi")
    if distinct_pathways:
        member = member.select("node_id", "other").distinct()
    pathways = member.groupBy("node_id").agg(F.count(F.lit(1)).alias("pathway_count"))
    proteins = nodes.filter(F.col("node_type") == "Protein").select("node_id").distinct()
    return proteins.join(degree, "node_id", "left").join(pathways, "node_id", "left").na.fill(0)


def induced_subgraph(nodes: DataFrame, edges: DataFrame, selected: DataFrame, owner: str) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends owned by selected entries; nodes owned or referenced by a kept edge."""
    owned = nodes.join(selected, owner, "left_semi").select("node_id").distinct()
    kept = edges.join(owned.select(F.col("node_id").alias("source")), "source", "left_semi").join(
        owned.select(F.col("node_id").alias("target")), "target", "left_semi")
    referenced = kept.select(F.explode(F.array("source", "target")).alias("node_id")).union(owned).distinct()
    return nodes.join(referenced, "node_id", "left_semi"), kept


def pair_graph_features(pairs: DataFrame, chains: DataFrame, features: DataFrame, pair: str) -> DataFrame:
    """Graph features summed over a pair's distinct receptor nodes.

    ``pairs``: pair, entry_id, receptor; ``chains``: entry_id, chain_id, node_id.
    """
    wanted = pairs.select(pair, "entry_id", F.explode("receptor").alias("chain_id"))
    linked = wanted.join(chains.select("entry_id", "chain_id", "node_id").distinct(), ["entry_id", "chain_id"]).select(
        pair, "node_id").distinct()
    measures = [c for c in features.columns if c != "node_id"]
    return linked.join(features, "node_id").groupBy(pair).agg(*[F.sum(m).alias(m) for m in measures])


def graph_context(rows: DataFrame, kind: str, owner: str, kinds: Sequence[str]) -> DataFrame:
    """Counts by type per owner id (upper-cased), wide."""
    return rows.groupBy(F.upper(F.col(owner)).alias(owner)).pivot(kind, list(kinds)).count().na.fill(0)


def sample_membership(examples: DataFrame, nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Graph sizes of each example's structure; whether it has a graph at all."""
    n = nodes.groupBy(key).agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy(key).agg(F.count(F.lit(1)).alias("edge_count"))
    return examples.join(n, key, "left").join(e, key, "left").na.fill(0, ["node_count", "edge_count"]).withColumn(
        "has_graph", F.col("node_count") > 0)
