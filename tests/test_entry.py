import importlib
import sys


def test_entry_registers_all_plans():
    import __spark_entry__ as e
    from quern import plans

    assert set(plans.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_optional_part(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__ as e

    again = importlib.reload(e)
    assert "bm25_topk" in again.queries() and "pipeline" not in again.queries()
    monkeypatch.undo()
    importlib.reload(e)
