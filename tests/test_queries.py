"""Every registered query against its SQL, on the smallest given tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from oracle_check import TESTDATA, compare, connect

import __spark_entry__ as entry
from pairwright.plans import catalog, oracle

SF_DIR = str(TESTDATA / "sf0.001")
QUERIES, SQL = catalog.queries(), oracle.oracle_sql()
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def _entry_of(root: Path, before: str = "") -> tuple[set[str], set[str]]:
    """The names that the entry of a copy registers, in a process of its own."""
    code = f"{before}\nimport __spark_entry__ as e\nprint(sorted(e.queries()), sorted(e.oracle_sql()), sep='\\n')"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    names, sql = done.stdout.splitlines()
    return set(eval(names)), set(eval(sql))


@pytest.mark.parametrize("state", ["whole", "absent", "empty", "lacking"])
def test_entry_without_the_training_part(tmp_path, state):
    """The queries of the library register whatever is left of the part that may be absent, and nothing of it."""
    root = tmp_path / "copy"
    absent = ("llm", "corpus_pipeline.py") if state in ("absent", "empty") else ()
    shutil.copytree(ROOT / "pairwright", root / "pairwright", ignore=shutil.ignore_patterns("__pycache__", *absent))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and name not in absent:
            shutil.copy(ROOT / name, root)
    if state == "empty":
        (root / "pairwright" / "llm").mkdir()
    blocked = "import sys; sys.modules['ahocorasick'] = None" if state == "lacking" else ""
    names, sql = _entry_of(root, blocked)
    assert set(QUERIES) <= names and set(SQL) <= sql
    if state == "whole" and (ROOT / "pairwright" / "llm").exists():
        assert names == set(entry.queries()) and sql == set(entry.oracle_sql())
    else:
        assert names == set(QUERIES) and sql == set(SQL)
