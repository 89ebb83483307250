import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from capital_access.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("8", shuffle_partitions=4, **{"spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='run-')}"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate expressions over one row of literals: ``one({"x": 1}, schema, expr, ...)``."""

    def evaluate(values, schema, *columns):
        return tuple(spark.createDataFrame([values], schema).select(*columns).first())

    return evaluate


def rows(df):
    """Rows as sorted tuples, missing values last."""
    return sorted((tuple(r) for r in df.collect()), key=lambda t: tuple((v is None, str(v)) for v in t))
