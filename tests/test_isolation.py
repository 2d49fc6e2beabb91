"""The rest of the library works without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["corvane/llm", "tests/llm"], ["corvane/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis", "spark-warehouse"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        else:
            path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, set(s) <= set(q))"
    env = os.environ | {"PYTHONPATH": str(copy)}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, pipeline, known = said.stdout.split()
    assert int(n) > 100 and pipeline == "False" and known == "True"


def test_rest_passes_without(tmp_path):
    """Tests of the rest pass where the corpus operators are gone."""
    copy, gone = tmp_path / "copy", ("llm", "corpus_pipeline.py")
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis", "spark-warehouse", *gone))
    some = ["tests/test_functions.py", "tests/test_vector_graph.py::test_links_and_walks", "tests/test_operators.py::test_upsert_policies", "tests/test_oracles.py::test_entry"]
    said = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-p", "no:cacheprovider", *some], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert said.returncode == 0, said.stdout[-2000:]
