"""Graph connectors: each source's (nodes, edges) under two declared schemas, merged over all that are enabled."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affinityloom.operators import graph as G

NODES = {"node_id": "string", "node_type": "string", "display_name": "string"}
EDGES = {"edge_id": "string", "edge_type": "string", "source": "string", "target": "string", "evidence": "double", "confidence": "string"}


@dataclass(frozen=True)
class Connector:
    """``connect`` turns a source's rows into (nodes, edges). ``fixed`` gives columns that it leaves out a constant text;
    others of the schemas are null. ``needs`` names a setting without which the connector is not enabled."""

    name: str
    connect: Callable[[DataFrame], tuple[DataFrame, DataFrame]]
    fixed: Mapping[str, str] = field(default_factory=dict)
    needs: str | None = None


CONNECTORS: dict[str, Connector] = {}


def register(connector: Connector) -> Connector:
    unknown = sorted(set(connector.fixed) - set(NODES) - set(EDGES))
    if unknown:
        raise ValueError(f"connector {connector.name}: no such columns in the schemas: {unknown}")
    if connector.name in CONNECTORS:
        raise ValueError(f"connector {connector.name} is registered already")
    CONNECTORS[connector.name] = connector
    return connector


def enabled_connectors(settings: Mapping[str, str | None] | None = None) -> list[str]:
    """Names in order of registration; those that need a setting only where it is given and not blank."""
    given = settings or {}
    return [c.name for c in CONNECTORS.values() if c.needs is None or (given.get(c.needs) or "").strip()]


def _shaped(frame: DataFrame, schema: Mapping[str, str], connector: Connector) -> DataFrame:
    own = dict(frame.dtypes)
    wrong = [f"{c} {own[c]}" for c, kind in schema.items() if own.get(c, kind) != kind]
    key = next(iter(schema))
    if wrong or key not in own:
        raise ValueError(f"connector {connector.name}: {key} is missing or types differ from the schema: {wrong}")
    return frame.select(*[F.col(c) if c in own else F.lit(connector.fixed.get(c)).cast(kind).alias(c) for c, kind in schema.items()],
                        F.lit(connector.name).alias("source_database"))


def connected_graph(rows: Mapping[str, DataFrame], settings: Mapping[str, str | None] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the enabled connectors that rows are given for.

    The connector registered first wins where an id comes from several; a node keeps the names of all of them.
    """
    unknown = sorted(set(rows) - set(CONNECTORS))
    if unknown:
        raise ValueError(f"no connectors {unknown}; known: {sorted(CONNECTORS)}")
    nodes, edges = [], []
    for name in enabled_connectors(settings):
        if name in rows:
            n, e = CONNECTORS[name].connect(rows[name])
            nodes.append(_shaped(n, NODES, CONNECTORS[name]))
            edges.append(_shaped(e, EDGES, CONNECTORS[name]))
    if not nodes:
        raise ValueError("no enabled connector has rows")
    return G.merge_nodes(nodes, ["node_type", "display_name"]), G.merge_edges(edges)


def pathway_graph(memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pathway nodes and edges, and a node for every protein that is a member."""
    nodes, edges = G.pathway_edges(memberships)
    proteins = edges.select(F.col("source").alias("node_id")).distinct().select(
        "node_id", F.lit("Protein").alias("node_type"), F.substring_index("node_id", ":", -1).alias("display_name"))
    return nodes.select("node_id", F.lit("Pathway").alias("node_type"), "display_name").unionByName(proteins), edges


register(Connector("network", lambda rows: G.interaction_network(rows, "a", "b", "score", 400), {"edge_type": G.PPI}))
register(Connector("pathways", pathway_graph, {"confidence": "high"}))
