"""The entry module without the operators on text."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_entry_without_the_operators_on_text(tmp_path):
    """An empty folder left behind, as __pycache__ leaves one, takes nothing else down."""
    shutil.copytree(ROOT / "plotmere", tmp_path / "plotmere", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "plotmere" / "llm").mkdir()
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
