"""Connector registry: enabled names, declared schemas, merging."""

import pytest

from affinityloom.operators import connectors as C


@pytest.fixture
def registry(monkeypatch):
    monkeypatch.setattr(C, "CONNECTORS", dict(C.CONNECTORS))


def test_a_connector_that_needs_a_setting(spark, registry):
    graph = lambda rows: (rows.selectExpr("a AS node_id"), rows.selectExpr("a AS edge_id", "a AS source", "a AS target"))
    C.register(C.Connector("keyed", graph, {"node_type": "Gene"}, needs="access_key"))
    assert C.enabled_connectors() == C.enabled_connectors({"access_key": " "}) == ["network", "pathways"]
    assert C.enabled_connectors({"access_key": "k"}) == ["network", "pathways", "keyed"]
    rows = spark.createDataFrame([("x",)], "a string")
    nodes, edges = C.connected_graph({"keyed": rows}, {"access_key": "k"})
    assert [tuple(r) for r in nodes.collect()] == [("x", "Gene", None, "keyed")] and edges.columns == [*C.EDGES, "source_database"]
    with pytest.raises(ValueError, match="no enabled connector"):
        C.connected_graph({"keyed": rows})


def test_what_does_not_fit_is_refused(spark, registry):
    rows = spark.createDataFrame([(1,)], "n int")
    with pytest.raises(ValueError, match="no such columns"):
        C.register(C.Connector("new", lambda r: (r, r), {"colour": "red"}))
    with pytest.raises(ValueError, match="registered already"):
        C.register(C.Connector("network", lambda r: (r, r)))
    C.register(C.Connector("typed", lambda r: (r.selectExpr("n AS node_id"), r)))
    with pytest.raises(ValueError, match="node_id int"):
        C.connected_graph({"typed": rows})
    with pytest.raises(ValueError, match="no connectors"):
        C.connected_graph({"unheard": rows})


def test_network_edges_are_sorted_by_narrow_rows(spark):
    """Ends with separators and other letters come back whole, and no text but the id is sorted."""
    from affinityloom.operators import graph as G

    rows = [("é:b", "a", 950, 2), ("a", "é:b", 500, 1), ("x", "b:é", 400, 3), ("z", "y", 399, 4), ("b:", "ab", 900, 5)]
    edges = G.interaction_network(spark.createDataFrame(rows, "a string, b string, s int, ord int"), "a", "b", "s", 400)[1]
    got = {r["edge_id"]: (r["source"], r["target"], r["evidence"], r["confidence"]) for r in edges.collect()}
    assert got == {"network:a:é:b": ("protein:a", "protein:é:b", 0.5, "medium"), "network:b:é:x": ("protein:b:é", "protein:x", 0.4, "medium"),
                   "network:ab:b:": ("protein:ab", "protein:b:", 0.9, "high")}
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("protein:") < plan.index("Window")
