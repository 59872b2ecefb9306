import math
import re
from collections import Counter

import pytest

from steward.llm import reversed_search as rs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOWER)) if text else []


def brute(items, docs, k):
    docs = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n_docs, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 100 - 25 + 25 * c.total() * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t in words(text)
                if t in c
            )
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        out += [(item, n + 1, i, -s) for n, (s, _, i) in enumerate(scored[:k])]
    return sorted(map(repr, out))


@pytest.fixture()
def items(spark):
    def build(*rows):
        return spark.createDataFrame([(i, t, 5, 6, "x") for i, t in rows], "item_id bigint, text string, item int, rank int, terms string")

    return build


def got(df):
    return sorted(map(repr, map(tuple, df.collect())))


ITEMS = [
    (1, "The cat, the HAT"), (2, None), (3, ""), (4, "--- ..."), (5, "Ünïcode größe 42"), (6, "nothing_shared zzz"),
    (7, "the " * 50), (7, "cat"), (None, "hat hat"),
]
DOCS = [
    (10, "the cat sat"), (11, "the cat sat"), (12, None), (13, ""), (14, "!!"), (15, "größe GRÖSSE 42 x"), (16, "hat " * 3000 + "cat"),
    (17, "the"), (10, "the cat sat"), (None, "a hat"), (None, "a hat"), (18, "ünïcode ÜNÏCODE"),
]


@pytest.mark.parametrize("k, block_bytes", [(20, 1 << 20), (2, 1 << 20), (3, 200)])
def test_against_brute_force(items, documents, monkeypatch, k, block_bytes):
    monkeypatch.setattr(rs, "CELLS", 12)  # several steps a batch
    found = rs.search(items(*ITEMS), documents(*DOCS), k, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(found) == brute(ITEMS, DOCS, k)


def test_many_partitions(items, documents):
    docs = [(i, f"w{i % 7} w{i % 11} w{i % 3} " * (i % 5 + 1)) for i in range(400)]
    asked = [(q, f"w{q % 11} w{q % 3}") for q in range(30)]
    assert got(rs.search(items(*asked), documents(*docs).repartition(9), 5)) == brute(asked, docs, 5)


def test_empty_tables(items, documents):
    none, some = documents((1, "x")).filter("false"), documents((1, "x"))
    assert rs.search(items((1, "x")), none).count() == 0
    assert rs.search(items((1, "x")).filter("false"), some).count() == 0


def test_heaps_keep_the_best():
    import numpy as np

    heaps = rs.Heaps(1, 2)
    heaps.push(np.array([[5], [0], [7]]), [3, 1, None])
    heaps.push(np.array([[7], [5]]), [9, 2])
    assert list(heaps.out()) == [(0, 7, 9), (0, 7, None)]
