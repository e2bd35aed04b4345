import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from publedger.session import local_session

    session = local_session("tests", 4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.adaptive.enabled", "false")  # tiny tables: planning twice costs more than it saves
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row."""

    def run(column, **cells):
        schema = ", ".join(f"{k} {kind}" for k, (_, kind) in cells.items()) or "x int"
        row = tuple(v for v, _ in cells.values()) or (1,)
        return spark.createDataFrame([row], schema).select(column).first()[0]

    return run
