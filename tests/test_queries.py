import importlib.util
import os

import pytest

from quillspan.plans import data, search, search_sql

QUERIES, SQL = search.QUERIES | data.QUERIES, search_sql.ORACLE | data.ORACLE


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(compare, name):
    compare(QUERIES[name], SQL[name])


def test_the_rest_without_sql():
    assert set(QUERIES) - set(SQL) == {"p5_found"}


def test_entry():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    spec = importlib.util.spec_from_file_location("entry_under_test", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    assert set(QUERIES) <= set(mod.queries()) and set(SQL) <= set(mod.oracle_sql()) <= set(mod.queries())


def test_workers_find_the_package_from_any_folder(tmp_path):
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", e.queries()["p5_found"](spark, "/root/testdata/sf0.001").count())
"""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "ROWS" in got.stdout, got.stderr[-2000:]
