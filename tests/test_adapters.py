"""Adapter registry: one schema, checked on registering and on use."""

import pytest
from pyspark.errors import AnalysisException

from affinityloom.sources import adapters as AD


@pytest.fixture
def registry(monkeypatch):
    monkeypatch.setattr(AD, "ADAPTERS", dict(AD.ADAPTERS))


def test_one_schema_for_all(spark):
    lines = spark.createDataFrame([("1abc 2.1 2001 7.3 Kd=5nM // x",)], "value string")
    none = lines.limit(0)
    both = AD.adapt_all({"index": lines, "site": none})
    assert {f.name: f.dataType.simpleString() for f in both.schema} == {"source": "string", **AD.SCHEMA}
    row = both.collect()[0]
    assert (row.source, row.entry_id, row.kind, row.value, row.standardized, row.mutation) == ("index", "1ABC", "Kd", 5.0, 5.0, None)


def test_what_does_not_fit_is_refused(spark, registry):
    rows = spark.createDataFrame([(1, "x")], "n int, t string")
    with pytest.raises(ValueError, match="no such columns"):
        AD.register(AD.Adapter("new", lambda r: r, {"volume": "n"}))
    with pytest.raises(ValueError, match="registered already"):
        AD.register(AD.Adapter("index", lambda r: r, {}))
    AD.register(AD.Adapter("typed", lambda r: r, {"value": "n"}))
    with pytest.raises(ValueError, match="value int"):
        AD.adapt("typed", rows)
    AD.register(AD.Adapter("named", lambda r: r, {"kind": "missing"}))
    with pytest.raises(AnalysisException):
        AD.adapt("named", rows)
    with pytest.raises(ValueError, match="no adapter"):
        AD.adapt("unheard", rows)
    with pytest.raises(ValueError, match="no sources"):
        AD.adapt_all({})


def test_an_own_adapter(spark, registry):
    AD.register(AD.Adapter("own", lambda r: r, {"kind": "t", "value": "double(n)"}))
    assert [(r.source, r.kind, r.value) for r in AD.adapt("own", spark.createDataFrame([(1, "x")], "n int, t string")).collect()] == [("own", "x", 1.0)]
