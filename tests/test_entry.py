"""The driver's entry with and without the training-data operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), e.WITHOUT_LLM)"


def run_in(folder: Path) -> list[str]:
    said = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert said.returncode == 0, said.stderr[-800:]
    return said.stdout.split(maxsplit=3)


@pytest.mark.parametrize("lost", [("shardwright/llm", "tests/llm"), ("shardwright/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, lost):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    before = run_in(copy)
    for name in lost:
        path = copy / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    after = run_in(copy)
    assert int(after[0]) >= 55 and after[2] == "0" and "shardwright.llm" in after[3] + str(after)
    if (ROOT / "shardwright/llm").is_dir():
        assert int(before[0]) - int(before[2]) == int(after[0])


def test_subpackage_without_its_libraries(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis"))
    (copy / "tokenizers.py").write_text("raise ModuleNotFoundError('not here', name='tokenizers')\n")
    assert int(run_in(copy)[0]) >= 55
