"""The library and its queries work where the training-data folders are deleted."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LLM = ("lumbrera/llm", "tests/llm", "corpus_pipeline.py")


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_imports_without_llm(tmp_path, pipeline):
    """With corpus_pipeline.py left behind, or deleted as well."""
    shutil.copytree(ROOT / "lumbrera", tmp_path / "lumbrera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        shutil.copy(ROOT / name, tmp_path / name)
    ask = "import __spark_entry__ as e; q = set(e.queries()); s = set(e.oracle_sql()); assert s <= q and len(q) > 100; print(any(n.startswith('op') or n == 'pipeline' for n in q))"
    done = subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, capture_output=True, text=True, check=True)  # noqa: S603
    assert done.stdout.strip() == "False"


def test_nothing_else_imports_llm():
    for path in [*(ROOT / "lumbrera").rglob("*.py"), *(ROOT / "tests").rglob("*.py"), ROOT / "bench.py"]:
        if not any(str(path.relative_to(ROOT)).startswith(x) for x in LLM) and path != Path(__file__):
            assert "lumbrera.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path
