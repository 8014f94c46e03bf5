"""Every registered query beside its SQL twin."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402
from conftest import SF  # noqa: E402
from riskweave.plans import registered  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_same_rows(spark, con, name):
    same, text = compare(spark, con, SF, name)
    assert same, text


def test_every_query_has_a_twin():
    assert set(registered.queries()) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_text_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "riskweave", tmp_path / "riskweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "oracles.py"):
        shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.queries()) == set(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.stdout.split() == [str(len(registered.queries())), "True"], done.stderr[-2000:]


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1000
