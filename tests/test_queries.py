"""Every registered query with SQL gives DuckDB's rows at the smallest scale.

The tables that many queries derive first (events, sessions, detector, results)
are built once for the whole module.
"""

import functools

import pytest

from tests.compare import compare, connect
from wireloom.plans import registry
from wireloom.sources.staging import materialize

SF = "0.001"
SLOW = {"stream_sessions"}  # has its own test


@pytest.fixture(scope="module", autouse=True)
def shared_tables():
    patch = pytest.MonkeyPatch()
    for name in ("_events", "_sessions", "_results"):
        build = getattr(registry, name)
        patch.setattr(registry, name, functools.cache(lambda s, d, b=build, n=name: materialize(b(s, d), n)))
    patch.setattr(registry, "_detector", functools.cache(registry._detector))
    timeline = registry._timeline
    patch.setattr(registry, "_timeline", functools.cache(lambda s, d, **o: materialize(timeline(s, d, **o), "tl")))
    yield
    patch.undo()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", [n for n in registry.SQL if n not in SLOW])
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, name, registry.QUERIES[name], registry.SQL[name], SF)
    assert ok, note
    assert "types" not in note, note


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["src_ip", "overall_anomaly_score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
