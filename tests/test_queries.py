"""Every registered query against its SQL, over whole tables."""

import pathlib
from collections import Counter

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from steward.registry import QUERIES

DATA = pathlib.Path("/root/testdata")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP",
}
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="benchmark tables not there")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/sf0.001/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(DATA / "sf0.001"))
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    cursor = duck.execute(oracle_sql()[name])
    types = {c[0]: str(c[1]) for c in cursor.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())


def test_no_query_without_sql():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_outcomes_are_those_in_the_fixture_notes(spark):
    out = queries()["adder_outcomes"](spark, str(DATA / "sf0.01"))
    assert Counter(r.outcome for r in out.collect()) == {
        "no_action": 560, "not_drawn": 472, "pull": 209, "no_room": 82, "size_unknown": 27,
    }
