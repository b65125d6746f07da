"""The entry point without the corpus subpackage, on a copy."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tidemark import catalog

REPO = Path(__file__).parents[1]
SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline_left", [True, False])
def test_imports_without_the_corpus_operators(tmp_path, pipeline_left):
    shutil.copytree(REPO / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (REPO / name).exists() and (pipeline_left or name != "corpus_pipeline.py"):
            shutil.copy(REPO / name, tmp_path)
    said = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert [line.split() for line in said.stdout.splitlines()] == [sorted(catalog.QUERIES), sorted(catalog.SQL)]
