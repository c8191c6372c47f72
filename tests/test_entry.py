import importlib
import sys

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_import_without_the_optional_subpackage(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("foliant.llm", "corpus_pipeline")) else real(name, *a))
    kept = {m: sys.modules.pop(m) for m in list(sys.modules) if m.startswith("foliant.llm")}
    try:
        assert not [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
        assert entry.queries()
    finally:
        sys.modules.update(kept)
