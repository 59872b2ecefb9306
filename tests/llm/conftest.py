import pathlib

import pytest

DATA = pathlib.Path("/root/testdata")


@pytest.fixture(scope="session")
def sf(request):
    """The smallest benchmark tables."""
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("benchmark tables not there")
    return str(folder)


@pytest.fixture()
def documents(spark):
    """Rows (doc_id, text) with columns whose names operators use themselves."""

    def build(*rows):
        schema = "doc_id bigint, text string, ids int, failed string, _row string, n_words string, fp string"
        return spark.createDataFrame([(i, t, 1, "x", "y", "z", "w") for i, t in rows], schema).coalesce(2)

    return build
