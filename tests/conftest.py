import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from steward.session import local_session  # noqa: E402

# Small patches and chunks still span several slices with this many partitions.
PARTITIONS = "4"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "steward-tests", 4, **{"spark.sql.shuffle.partitions": PARTITIONS, "spark.driver.memory": "4g"}
    )
    yield session
    session.stop()


@pytest.fixture()
def table(spark):
    """A small DataFrame from a DDL schema and rows."""

    def build(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return build


@pytest.fixture()
def catalog(spark):
    """A catalog from (node, id, size, status, replications) rows."""
    from steward.schemas import CATALOG
    import datetime

    then = datetime.datetime(2024, 1, 1)

    def build(*rows):
        return spark.createDataFrame(
            [(n, i, f"{i}.png", s, st, then, r) for n, i, s, st, r in rows], CATALOG
        )

    return build
