import pytest

from metrum import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows and a schema string to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows(df, *order):
    """All rows as tuples, in a given order."""
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
