"""The driver contract, with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_query_with_sql_is_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_loads_without_the_optional_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; names = set(e.queries()); assert names and set(e.oracle_sql()) <= names; print(*sorted(names))"
    for keep_pipeline in (True, False):
        if not keep_pipeline:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        assert "mask_edges" in done.stdout and "op1_" not in done.stdout and "pipeline" not in done.stdout
