"""Driver contract: entry smoke check and every query against its DuckDB oracle (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from dropledger.plans import registry
from dropledger.session import TABLES
from tests.conftest import SF_SMALL
from tools.oracle_check import _digest


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns[:4] == ["publish_ym", "data_year", "data_month", "succeeded"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    """Those of the engine; the optional llm subpackage tests what SQL can't express by itself."""
    registry.load_all()
    assert set(registry.QUERIES) == set(registry.ORACLE)
    assert len(registry.QUERIES) >= 70
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, duck, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(E.oracle_sql()[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _digest(sdf.columns, srows)[0] == _digest(dcols, drows)[0]


def test_driver_style_session_from_another_directory(tmp_path):
    """A fresh interpreter, another working directory, a default session:
    executor Python workers must still import the package (it is shipped)."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
assert E.entry(spark).count() > 0
assert E.queries()["archive_stats"](spark, "/root/testdata/sf0.001").count() > 0
print("DRIVER-OK")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", script], cwd=str(tmp_path), env=env,
                         capture_output=True, text=True, timeout=600)
    assert "DRIVER-OK" in out.stdout, out.stderr[-2000:]
