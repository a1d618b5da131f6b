"""Every query against its SQL at the smallest scale."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect
from trackspan.plans import catalog

FOLDER = "/root/testdata/sf0.001"
OWN = set(catalog.runnable())
SQL = {name: sql for name, sql in entry.oracle_sql().items() if name in OWN}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, entry.queries()[name], SQL[name], FOLDER) is None
    spark.catalog.clearCache()


def test_every_query_runs_and_is_known():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert OWN <= set(entry.queries())
    assert OWN == set(SQL)


def test_entry_without_the_training_data_package(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/trackspan", tmp_path / "trackspan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(__import__('trackspan.plans.catalog').plans.catalog.runnable()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert done.stdout.strip() == "True", done.stderr


def test_entry(spark):
    assert entry.entry(spark).count() > 0
