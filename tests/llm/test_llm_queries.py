"""Every pN_ query that SQL can express, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from conftest import DATA

from gleaner.llm.oracle import oracle_sql
from gleaner.llm.queries import queries
from tools.compare import rows_of


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, con, name):
    df = queries()[name](spark, DATA)
    got = con.execute(oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, name):
    assert queries()[name](spark, DATA).count() > 0
