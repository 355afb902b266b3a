import importlib
import sys

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_text_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("lonja.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "lonja.llm", None)
    again = importlib.reload(entry)
    assert "p1_found" in again.queries() and "p8_ids" not in again.queries()
    monkeypatch.undo()
    importlib.reload(entry)
