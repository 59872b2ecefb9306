import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steward.llm import topk
from steward.llm.queries import QUERIES


def brute(queries, candidates, k):
    def usable(rows):
        return [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]

    out = []
    for q, v in usable(queries):
        mine = [math.floor(1024 * x) for x in v]
        scored = []
        for c, w in usable(candidates):
            if c != q:
                theirs = [math.floor(1024 * x) for x in w]
                scored.append((-sum(a * b for a, b in zip(mine, theirs, strict=False)), c is None, c))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(q, n + 1, c, -s) for n, (s, _, c) in enumerate(scored[:k])]
    return sorted(map(repr, out))


def got(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute([r for r in rows if r[0] % 100 == 0], rows, 10)
    assert got(QUERIES["op8_top_k"](spark, sf)) == want


@pytest.mark.parametrize("block", [3, 1024])
def test_ties_nulls_and_lengths(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SLICE", 2)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(-2, 3, 17).astype(float).tolist()) for i in range(40)]
    rows += [(100 + i, [1.0] * 17) for i in range(12)]
    rows += [(200, None), (201, [None, 1.0]), (202, [float("nan")]), (203, [float("inf")]), (204, []), (205, [0.5])]
    rows += [(300, [1.5] * 20), (300, [1.5] * 20), (None, [1.0] * 17), (301, [-0.0004] * 3)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    df = df.withColumn("score", F.lit("x")).withColumn("ids", F.lit(1))
    asked = df.filter("vec_id % 5 = 0")
    want = brute([r for r in rows if r[0] is not None and r[0] % 5 == 0], rows, 10)
    assert got(topk.top_k(asked, df)) == want


def test_large_components_are_exact(spark):
    rows = [(0, [1e6, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 2.0]), (3, [-1e6, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert got(topk.top_k(df, df, k=2)) == brute(rows, rows, 2)


def test_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    assert topk.top_k(df.filter("false"), df).count() == 0
    assert topk.top_k(df, df.filter("false")).count() == 0
    assert topk.top_k(df, df).count() == 0


def test_statistics_bound_products():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(50, 64)), rng.normal(size=(60, 64))
    coarse, fine = (topk._statistics(a, n) @ topk._statistics(b, n).T for n in topk.LEVELS)
    assert (coarse >= a @ b.T - 1e-9).all() and (fine >= a @ b.T - 1e-9).all()
    assert fine.mean() < coarse.mean()


def test_bounds_drop_candidates(monkeypatch):
    """Where lengths differ much, hardly any product is computed after the first block."""
    rng = np.random.default_rng(0)
    made = []
    exact = topk._products
    monkeypatch.setattr(topk, "_products", lambda a, b: made.append(len(a) * len(b)) or exact(a, b))
    q = np.floor(rng.normal(size=(5, 64)) * 100)
    blocks = [(np.arange(100), np.floor(rng.normal(size=(100, 64)) * 500))]
    blocks += [(np.arange(100) + 100 * k, np.floor(rng.normal(size=(100, 64)) * 5)) for k in range(1, 10)]
    topk._search((np.full(5, -1), q), blocks, 10)
    assert sum(made) < 0.3 * 5 * 1000
