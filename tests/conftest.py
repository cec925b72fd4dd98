import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from civisight.session import local_session

    session = local_session("8", shuffle_partitions=4)
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate columns on one row of string values."""
    def run(*cols, **row):
        fields = ", ".join(f"{k} string" for k in row) or "_x string"
        df = spark.createDataFrame([tuple(row.values()) or (None,)], fields)
        return tuple(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())
    return run
