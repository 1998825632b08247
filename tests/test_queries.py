"""Every registered query against its SQL, and the entry point."""

from __future__ import annotations

import importlib.util
import subprocess
import sys

import pytest
from conftest import ROOT, same

from quillspark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(registry.QUERIES[name](spark, sf_dir), *duck(sf_dir, registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries()) and set(registry.QUERIES) <= set(e.queries())


def test_entry_without_the_llm_folder(tmp_path):
    """The entry point and all other queries work when llm and corpus_pipeline.py are gone."""
    import shutil

    shutil.copytree(ROOT / "quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_nothing_else_imports_llm():
    for p in (ROOT / "quillspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "quillspark.llm" not in p.read_text()
    assert importlib.util.find_spec("quillspark") is not None
