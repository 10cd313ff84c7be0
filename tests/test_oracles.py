"""Every query that has SQL gives DuckDB's rows on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tracewell.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(tidy(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_every_query_has_rows_or_sql():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_point_imports_without_training_data_package(tmp_path):
    """The registry stands alone: the entry point's import guard is all that names the package."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['tracewell.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'exact_redelivery' in q"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
