import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from steward.llm import maxent as me
from steward.llm.queries import QUERIES


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), "\n"]


def held(doc_id):
    return doc_id is not None and crc32(str(doc_id).encode()) % 7 == 2


def base(docs):
    counts = Counter(t for i, text in docs if not held(i) for t in tokens(text))
    n, v = counts.total(), len(counts)
    for i, text in docs:
        words = tokens(text)
        yield i, held(i), len(words), sum(t in counts for t in words), n, sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in words)


def compare(rows, docs):
    key = lambda r: repr(r[:5])
    got, want = sorted(map(tuple, rows), key=key), sorted(base(docs), key=key)
    assert [r[:5] for r in got] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in got], [w[5] for w in want])
    assert all(math.isfinite(r[6]) and r[6] < 0 for r in got)


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows = QUERIES["op13_lm_scoring"](spark, sf).collect()
    compare(rows, docs)


def test_held_out_documents_are_likelier_than_by_single_words(spark, sf):
    rows = QUERIES["op13_lm_scoring"](spark, sf.replace("0.001", "0.01")).filter("held_out").collect()
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert gain > 0.03, gain
    assert sum(r.score > r.base_score for r in rows) > 0.85 * len(rows)


@pytest.mark.parametrize("block_bytes, part_bytes", [(1 << 20, 1 << 20), (30, 64)])
def test_nulls_ties_and_clashing_names(documents, block_bytes, part_bytes):
    docs = [
        (1, "The cat"), (2, None), (3, ""), (4, "the CAT sat"), (4, "the CAT sat"), (None, "no id"), (None, None), (5, "ÄÖ äö \x85 \x0b x"),
        (6, "word " * 20_000), *[(i, f"w{i} the") for i in range(10, 40)],
    ]
    assert any(held(i) for i, _ in docs)
    found = me.score(documents(*docs), block_bytes=block_bytes, part_bytes=part_bytes)
    compare(found.collect(), docs)


def test_nothing_to_learn_from_and_no_rows(documents):
    rows = me.score(documents((1, "a b"), (2, "a")), held=F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in rows)
    assert me.score(documents((1, "x")).filter("false")).count() == 0


def model_of(rng):
    sums = np.stack([rng.integers(0, 50, me.SYMBOLS), rng.integers(0, 5, me.SYMBOLS)])
    model = me.Model(sums)
    model.weights[:] = rng.normal(0, 0.5, model.weights.shape)
    return model


def test_probabilities_sum_to_one():
    model = model_of(np.random.default_rng(1))
    for before in ([], [3], [700, 2, 9]):
        total = sum(
            math.exp(model.log_probability(np.array([*before, s]), np.array([len(before) + 1]))[-1]) for s in range(me.SYMBOLS)
        )
        assert total == pytest.approx(1, abs=1e-4)


def test_log_probability_by_hand():
    rng = np.random.default_rng(2)
    model, ranks, lengths = model_of(rng), rng.integers(0, me.SYMBOLS, 60), np.array([1, 40, 19])
    got, at = model.log_probability(ranks, lengths), 0
    for n in lengths:
        doc = ranks[at : at + n].tolist()
        for k, symbol in enumerate(doc):
            frequent = [s for s in doc[:k] if s < me.FREQUENT][::-1] + [me.FREQUENT] * 2
            before = [np.array([doc[k - 1] if k else me.START]), np.array(frequent[:1]), np.array(frequent[1:2])]
            klass, place = divmod(symbol, me.PLACES)
            z = model.class_prior + sum(model.weights[r[0]] for r in me.class_rows(before))
            y = model.place_prior[klass] + sum(model.weights[r[0]] for r in me.place_rows(before, np.array([klass])))
            want = z[klass] - np.log(np.exp(z).sum()) + y[place] - np.log(np.exp(y).sum())
            assert got[at + k] == pytest.approx(want, abs=1e-3)
        at += n


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    z, target = rng.normal(0, 1, (1, 6)), np.array([2])

    def likelihood(x):
        return x[0, 2] - np.log(np.exp(x).sum())

    slope = me.gradient(z.copy(), target)[0]
    for k in range(6):
        moved = z.copy()
        moved[0, k] += 1e-6
        assert slope[k] == pytest.approx((likelihood(moved) - likelihood(z)) / 1e-6, abs=1e-4)


def test_training_raises_the_likelihood_and_means_are_weighted():
    import pyarrow as pa

    model = me.Model(np.ones((2, me.SYMBOLS), dtype=np.int64))
    ranks, lengths = np.tile([5, 300, 9, 700], 500), np.array([2000])
    trainer, before = me.Trainer(model), model.log_probability(ranks, lengths).sum()
    for _ in range(3):
        trainer.learn(ranks, lengths)
    model.weights[:] = trainer.weights
    assert model.log_probability(ranks, lengths).sum() > 0.8 * before
    rows = [np.full(me.CLASSES, x, "<f2").tobytes() for x in (1, 4, 2)]
    group = pa.table({"row": [7, 7, 8], "task": [0, 1, 1], "visits": [2, 1, 5], "added": pa.array(rows, pa.binary())})
    mean = me._mean((pa.scalar(0), pa.scalar(0)), group)
    assert mean["row"].to_pylist() == [7, 8] and mean["visits"].to_pylist() == [3, 5]
    assert [np.frombuffer(a, "<f2")[0] for a in mean["added"].to_pylist()] == [2, 2]


def test_words_of_one_ending_are_told_apart(documents):
    """What follows a word depends on the whole word."""
    taught = [(i, "walking left" if i % 2 else "talking right") for i in range(2000)]
    asked = [(-1, "walking left"), (-2, "walking right"), (-3, "talking right"), (-4, "talking left")]
    rows = me.score(documents(*taught, *asked), held=F.col("doc_id") < 0).filter("held_out").collect()
    score = {r.doc_id: r.score for r in rows}
    assert min(score[-1], score[-3]) > max(score[-2], score[-4]) + 0.5, score
