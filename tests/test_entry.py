"""The driver's entry: every query that has SQL gives the same rows as DuckDB, with and without the training-text subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E

SF = Path("/root/testdata/sf0.001")
PLANS = {k: (f, plan.SQL.get(k)) for plan in E.PLANS for k, f in plan.QUERIES.items()}
needs_tables = pytest.mark.skipif(not SF.exists(), reason="the shared tables are not here")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@needs_tables
@pytest.mark.parametrize("name", sorted(PLANS))
def test_same_rows_as_sql(spark, name):
    query, sql = PLANS[name]
    got = query(spark, str(SF)).toPandas()
    if sql is None:
        assert len(got)
        return
    con = duckdb.connect()
    for f in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@needs_tables
def test_entry_has_rows(spark):
    assert E.entry(spark).count() > 0


def test_without_the_subpackage():
    code = "import sys; sys.modules['captionlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as E; q, s = E.queries(), E.oracle_sql(); assert q and set(s) <= set(q) and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parent.parent)


def test_names():
    assert set(E.oracle_sql()) <= set(E.queries())
