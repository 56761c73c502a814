from __future__ import annotations

import re
from pathlib import Path

import __spark_entry__ as e

HERE = Path(__file__).resolve().parent.parent


def test_every_check_has_its_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    df = e.entry(spark)
    assert df.columns == ["doc_id", "chunk_index", "score", "citation"] and df.count() == 5


def test_only_the_entry_names_the_llm_package():
    for p in (HERE / "corpusloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", p.read_text(), re.M), p


def test_no_local_checkpoint_or_cross_join():
    for p in (HERE / "corpusloom").rglob("*.py"):
        assert "localCheckpoint" not in p.read_text() and "crossJoin" not in p.read_text(), p


def test_the_core_stays_without_what_the_llm_package_needs(monkeypatch):
    import sys

    for name in [n for n in sys.modules if n.startswith("corpusloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    names = set(e.queries())
    assert "search_documents" in names and set(e.oracle_sql()) <= names and not any(n.startswith("p1_") for n in names)
