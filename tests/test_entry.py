"""The contract of __spark_entry__, with and without the subpackage that may be missing."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    assert E.entry(spark).limit(5).count() == 5


def test_sql_only_for_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 90


def test_rest_works_without_llm():
    code = "import sys; sys.modules['strikeloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op') and n[2].isdigit()], q; assert len(q) > 80; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_llm():
    found = [p for p in (ROOT / "strikeloom").rglob("*.py") if "llm" not in p.parts and "strikeloom.llm" in p.read_text()]
    assert not found
