import importlib
import sys

import __spark_entry__


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_corpus_operators(monkeypatch):
    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("stratagrid.llm"):
                raise ModuleNotFoundError(name)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("stratagrid.llm")]:
        monkeypatch.delitem(sys.modules, name)
    import stratagrid

    monkeypatch.delattr(stratagrid, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    entry = importlib.reload(__spark_entry__)
    assert entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
