import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from steward.llm import simhash
from steward.llm.components import roots
from steward.llm.queries import QUERIES


def brute_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute_components(prints):
    """(id, print) rows to the smallest id reachable over links of three bits."""
    kinds = sorted({p for _, p in prints})
    x = np.array(kinds, dtype=np.uint64)
    near = np.argwhere(np.bitwise_count(x[:, None] ^ x[None, :]) <= 3)
    of = groups(kinds, [(kinds[i], kinds[j]) for i, j in near if i < j])
    least = {}
    for i, p in prints:
        if i is not None:
            least[of[p]] = min(least.get(of[p], i), i)
    return [(i, least.get(of[p])) for i, p in prints]


def test_fingerprints():
    texts = [None, "", " \n", "One", "one TWO", "a b c", "É é A a", "x y z x y z x y z", "w " * 70_000 + "end"]
    assert [simhash.fingerprint(t) for t in texts] == [brute_print(t) for t in texts]


@pytest.mark.parametrize("tile", [3, 2048])
def test_links_of_clustered_fingerprints(spark, tile):
    rng = random.Random(5)
    prints = []
    for c in range(25):
        now = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            prints.append(now)
            for _ in range(rng.randint(0, 4)):
                now ^= 1 << rng.randrange(64)
    rows = [(i, p) for i, p in enumerate(prints)]
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in rows]
    df = spark.createDataFrame(signed, "id bigint, fp bigint")
    found = {r.fp: r.component_id for r in simhash.components(df, "id", tile=tile).collect()}
    assert [(i, found[p]) for i, p in signed] == brute_components(rows)


def test_more_bits_than_blocks_allow(spark):
    with pytest.raises(ValueError, match="blocks"):
        simhash.links(spark.createDataFrame([], "fp bigint"), bits=4)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    prints = [(d.doc_id, brute_print(d.text)) for d in docs]
    rows = QUERIES["op4_simhash"](spark, sf).collect()
    assert {(r.doc_id, r.fingerprint) for r in rows} == {(i, f"{p:016x}") for i, p in prints}
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted(brute_components(prints))


EDGES = [(7, None), (3, ""), (9, "same words here"), (4, "same words here"), (4, "same words here"), (None, "other text, all told"), (None, "SAME words here")]


def test_edges(documents):
    rows = simhash.near_duplicates(documents(*EDGES)).collect()
    want = brute_components([(i, brute_print(t)) for i, t in EDGES])
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in rows))) == sorted(map(repr, want))
    empty = documents((1, "x")).filter("false")
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_one_of_each_group_stays(documents):
    docs = documents(*EDGES)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.first()._row == "y"
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(
        map(repr, [(3, ""), (4, "same words here"), (None, "other text, all told")])
    )


def test_the_place_in_files_tells_repeated_rows_apart(spark, documents, tmp_path):
    docs = documents(*EDGES)
    assert simhash.file_place(docs) is None
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    read = spark.read.parquet(str(tmp_path / "docs"))
    kept = simhash.keep_one(read, place=simhash.file_place(read))
    assert kept.columns == docs.columns
    rows = sorted((r.doc_id is None, r.doc_id, r.text) for r in kept.collect() if r.doc_id is not None)
    assert rows == [(False, 3, ""), (False, 4, "same words here")] and kept.count() == 3


@pytest.mark.parametrize("seed", range(2))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + list(zip(chain, chain[1:], strict=False))
    edges += [(500, 501 + k) for k in range(300)] + [(900, 900), (None, 901)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    nodes = {n for e in edges for n in e if n is not None}
    want = groups(nodes, [e for e in edges if None not in e])
    found = {r.node: r.root for r in roots(df).collect()}
    assert {n: found.get(n, n) for n in nodes} == want
    assert roots(df.filter(F.lit(False))).count() == 0
