import os
import sys

import pytest

ROOT = "/root/testdata/sf0.001"


def test_registry_is_consistent():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 60


def test_core_imports_without_the_subpackage(monkeypatch):
    import importlib

    monkeypatch.setitem(sys.modules, "sceneloom.llm", None)
    monkeypatch.delitem(sys.modules, "sceneloom.llm.queries", raising=False)
    import __spark_entry__ as e

    try:
        importlib.reload(e)
        assert e.llm is None and not any(n.startswith("p1_") for n in e.queries())
    finally:
        monkeypatch.undo()
        importlib.reload(e)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
