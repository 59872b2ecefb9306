import importlib.util
import pathlib
import sys
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from steward.llm import langid, quality, simhash
from steward.llm.oracle import ORACLE
from steward.llm.queries import BYTE_LEVEL, QUERIES
from steward.llm.tokens import Encoder

sys.path.insert(0, str(pathlib.Path(__file__).parent))
from test_secrets import masked  # noqa: E402
from test_simhash import brute_components, brute_print  # noqa: E402

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")


def brute(rows):
    """(doc_id, text) that reach the last stage, each stage over what the one before kept."""
    kept = []
    for r in rows:
        named = dict(zip(quality.MEASURES, quality.measure(r.text), strict=True))
        if not any(rule(named.__getitem__) for rule in quality.RULES.values()):
            kept.append(r)
    import zlib

    taught = [r for r in kept if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    made = langid.Bundler()
    vectors = np.rint(made.bundle([r.text for r in taught]) * (1 << 20))
    names = sorted({r.lang for r in taught})
    sums = np.stack([vectors[[r.lang == n for r in taught]].sum(axis=0) for n in names])
    profiles = langid.Profiles(tuple(names), sums / np.linalg.norm(sums, axis=1)[:, None])
    told, scores = profiles.judge([r.text for r in kept])
    kept = [r for r, n, s in zip(kept, told, scores, strict=True) if n != "und" and s >= 0.1]
    of = brute_components([(r.doc_id, brute_print(r.text)) for r in kept])
    kept = [r for r, (i, c) in zip(kept, of, strict=True) if i == c]
    return {r.doc_id: masked(r.text) for r in kept}


def test_against_brute_force(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = brute(docs)
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id].append(r)
    assert set(got) == set(want)
    encode = Encoder(BYTE_LEVEL).whole
    for i, pieces in got.items():
        ids = b"".join(p.ids for p in sorted(pieces, key=lambda p: p.start))
        assert ids == np.append(encode(want[i]), 0).astype("<u4").tobytes()


def test_stages_keep_the_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names


def test_stages_on_odd_rows(spark, sf):
    import corpus_pipeline

    text = " ".join(f"the quick brown fox number{k}" for k in range(6))
    rows = [(1, None, None, "s", 0), (2, "", "en", None, None), (3, text, "en", "s", 5), (3, text, "en", "s", 5), (None, text + " x", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for part in (docs, docs.filter("false")):
        now = part
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, part, sf).collect()
            now = stage(spark, now, sf)
        assert len({r.doc_id for r in now.collect()}) <= 2


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLE[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    types = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "string": "VARCHAR"}
    assert {f.name: types[f.dataType.simpleString()] for f in df.schema.fields} == {c[0]: str(c[1]) for c in cursor.description}
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(cursor.fetchall())


def test_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {"pipeline", *QUERIES} <= names and set(ORACLE) <= set(__spark_entry__.oracle_sql())
    assert simhash.BITS == 3
