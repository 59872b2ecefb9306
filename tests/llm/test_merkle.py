from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from steward.llm import merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def siblings(tree, at):
    for nodes in tree[:-1]:
        yield (at % 2, nodes[at ^ 1] if at ^ 1 < len(nodes) else None)
        at //= 2


def brute(rows):
    """rows (doc_id, source, lang, n_chars, text) -> (doc_id, leaf, subroot, root, proof, folded, verified)"""
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=order) for x in langs}
    low = {x: levels([leaf(r) for r in trees[x]]) for x in langs}
    top = levels([low[x][-1][0] for x in langs])
    out = []
    for n, x in enumerate(langs):
        for k, r in enumerate(trees[x]):
            way = [*siblings(low[x], k), *siblings(top, n)]
            bad = r[0] is not None and __import__("zlib").crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            end = leaf((*r[:3], r[3] + 1, r[4])) if bad else leaf(r)
            for odd, sibling in way:
                end = h(end) if sibling is None else h(sibling, end) if odd else h(end, sibling)
            root = top[-1][0]
            out.append((r[0], leaf(r), low[x][-1][0], root, h(*[s for _, s in way if s]), end, end == root))
    return sorted(map(repr, out))


def proved(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    df = df.withColumn("idx", F.lit("x")).withColumn("tree", F.lit(1)).withColumn("root", F.lit(2)).repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    told = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    claim = merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), told, F.col("text"))
    return sorted(repr(tuple(r)) for r in merkle.checked(merkle.manifest(df.withColumn("claim", claim))).collect())


@pytest.mark.parametrize("levels_a_block", [1, 2, 10])
def test_against_brute_force(spark, monkeypatch, levels_a_block):
    monkeypatch.setattr(merkle, "LEVELS", levels_a_block)
    rows = [(i, f"s{i % 3}", ["en", "de", "fr", "x"][min(3, i % 7)] if i % 5 else "en", i, "text " * (i % 4)) for i in range(57)]
    rows += [
        (100, None, None, None, None), (101, "s", None, 3, ""), (None, "s", "en", 3, "ü"), (None, "s", "en", 3, "ü"), (7, "s", "en", 3, "tie"),
        (103, "s", "", 3, "a group of no name"), (104, "s", "日本", 9, "long " * 50_000),
    ]
    assert proved(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_small_tables(spark, n):
    rows = [(i, "s", "en", 1, "t") for i in range(n)]
    assert proved(spark, rows) == brute(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.manifest(df).count() == 0


def test_blocks_fold_to_the_same_nodes():
    nodes = [bytes([k]) * 32 for k in range(11)]
    whole = [r for r in merkle.fold_block(0, nodes, True, 10)]
    assert len([r for r in whole if r[3] is None]) == 1 and whole[-1][0] == 4
    assert [r[1] for r in merkle.fold_block(8, nodes[8:], False, 2)] == [8, 9, 10, 4, 5, 2]


def test_a_segment_leads_to_the_root():
    nodes = [bytes([k]) * 32 for k in range(5)]
    rows = list(merkle.fold_block(0, nodes, True, 10))
    step = {(up, i): seg for up, i, _, seg in rows}
    for k, node in enumerate(nodes):
        assert merkle.folded(node, b"".join(step[up, k >> up] for up in range(3))) == rows[-1][2]
