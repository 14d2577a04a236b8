"""Every query with SQL against DuckDB over the smallest tables, and the driver contract."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from piperack.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    return round(v, 6) + 0.0 if isinstance(v, float) else v if isinstance(v, (int, bool)) else str(v)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr(tuple(map(plain, r))) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_sql(spark, oracle, name):
    found, expected = catalogue.QUERIES[name](spark, SF).toPandas(), oracle.sql(catalogue.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)


def test_entry_without_the_optional_parts(tmp_path):
    """The registry imports, and has all other queries, where the llm subpackage and the pipeline can't be imported."""
    code = "import sys; sys.modules['piperack.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": root})
    assert out.stdout.split() == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES))], out.stderr


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
