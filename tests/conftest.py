import pytest

from gleaner.session import get_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)
