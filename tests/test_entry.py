"""The driver contract, with and without the removable text operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__spark_entry__.__file__).parent


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 500


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_works_without_the_text_operators(tmp_path):
    shutil.copytree(REPO / "starloom", tmp_path / "starloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries())[0], any(n.startswith('op') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
    assert said.stdout.split() == ["any_negative", "False"]


def test_nothing_else_imports_the_text_operators():
    for path in (REPO / "starloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "starloom.llm" not in path.read_text()
