"""Every query of the core against its SQL."""

import duckdb
import pytest
from conftest import DATA

from gleaner.plans.queries import oracle_sql, queries
from tools.compare import rows_of


@pytest.fixture(scope="module")
def con():
    from pathlib import Path

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


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_plans_stay_in_the_jvm(spark):
    for name in ("ngram_score", "keyword_and_or", "relevancy", "scaled_scores"):
        plan = queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan


def test_filters_reach_the_scan(spark):
    plan = queries()["acl"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<file_idx:string,permit_list:array<string>>" in plan
