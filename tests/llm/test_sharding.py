from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from steward.llm import sharding
from steward.llm.queries import QUERIES


def checked(rows, shards):
    """Bytes per shard; slots are gapless from 0."""
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += len((r.text or "").encode()) + 16
    for found in slots.values():
        assert sorted(found) == list(range(len(found)))
    assert set(slots) <= set(range(shards))
    return [sizes[k] for k in range(shards)]


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op5_sharding"](spark, sf).collect()
    assert len(rows) == len(docs)
    by_shard = defaultdict(int)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, crc32(data), "bytes", None)
        by_shard[r.shard] += r.size
    largest = max(r.size for r in rows)
    mean = sum(by_shard.values()) / 40
    assert max(abs(by_shard[k] - mean) for k in range(40)) <= largest + 1


@pytest.mark.parametrize("slice_bytes", [1 << 30, 3000])
def test_hot_text_is_cut_and_others_are_not(spark, slice_bytes):
    rng = np.random.default_rng(1)
    rows = [(i, "hot text " * 5) for i in range(700)]
    rows += [(1000 + i, "x" * int(rng.integers(0, 200)) + f" {i // 3}") for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    out = sharding.shard(df, shards=8, tolerance=0.01, slice_bytes=slice_bytes).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted(rows)
    sizes = checked(out, 8)
    assert max(sizes) - min(sizes) <= 0.03 * np.mean(sizes) + 2 * 220
    where = defaultdict(set)
    for r in out:
        where[r.text].add(r.shard)
    assert len(where.pop("hot text " * 5)) >= 2
    assert sum(len(s) > 1 for s in where.values()) <= 7


def test_order_does_not_matter(spark):
    rows = [(i, f"text {i % 50} " * (i % 7)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    a, b = (
        sorted((r.doc_id, r.shard, r.slot) for r in sharding.shard(d, shards=5).collect())
        for d in (df.repartition(1), df.repartition(7))
    )
    assert a == b


def test_edges(documents):
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "one"), (None, "one"), (4, "long " * 100_000)]
    docs = documents(*rows)
    out = sharding.shard(docs, shards=4).collect()
    assert len(out) == len(rows) and checked(out, 4)
    assert sharding.shard(docs.filter("false"), shards=4).count() == 0
    assert sharding.shard(docs.filter("doc_id = 4"), shards=4).count() == 1
    assert set(docs.columns) < set(sharding.shard(docs, shards=1).columns)
