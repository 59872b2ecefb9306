import re
from collections import Counter

import pytest

from steward.llm import quality
from steward.llm.queries import QUERIES

EDGES = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "a b c d e " * 3), (6, "x\ny\nx\n\n\nx"),
    (7, "ÉÀ Ab CD ef 12 ## !!"), (8, "w" * 300_000 + " tail"), (8, "one"), (None, "one\x0btwo\x0cthree"),
    (9, "nb\xa0sp \x1c sep"), (10, "p q r s t p q r s t p q r s"),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(hit),
        len(lines),
        len(set(words)),
        sum(bool(re.search(r"[A-Za-z]|[^\x00-\x7f]", w)) for w in words),
        sum(bool(re.search("[A-Z]", w)) and not re.search("[a-z]", w) for w in words),
        len(re.findall("[!?]", text)),
    )


def judged(m):
    named = dict(zip(quality.MEASURES, m, strict=True))
    return sum(1 << k for k, rule in enumerate(quality.RULES.values()) if rule(named.__getitem__))


def test_measurements_and_bits(documents):
    rows = quality.ledger(documents(*EDGES)).collect()
    want = sorted((repr(i), *brute(t), judged(brute(t))) for i, t in EDGES)
    assert sorted((repr(r[0]), *r[1:-1]) for r in rows) == want


def test_windows_survive_renumbering():
    words = [b"%d" % (k % 40_000) for k in range(120_000)]
    assert quality.repeated_words(words) == (40_000, 120_000)
    words = [b"%d" % k for k in range(70_000)]
    assert quality.repeated_words(words) == (70_000, 0)


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        m = brute(d.text)
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m[:5]
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0])
        assert r.kept == (judged(m) == 0)


def test_labels_agree(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op1_quality_rules"](spark, sf).collect() if r.doc_id in labels]
    good = [r for r in rows if labels[r.doc_id] == 1 and not r.base_failed]
    assert good and all(r.kept for r in good)
    bad = [r for r in rows if labels[r.doc_id] == 0]
    assert sum(r.kept for r in bad) <= 0.35 * len(bad)


def test_policies_and_ablations(documents):
    book = quality.ledger(documents(*EDGES))
    rows = {(r.policy, r.rule): r for r in quality.ablations(book, [quality.BASE, quality.CLEAN]).collect()}
    bits = [r.failed for r in book.collect()]
    for p in (quality.BASE, quality.CLEAN):
        for rule in p.rules:
            bit = 1 << list(quality.RULES).index(rule)
            r = rows[p.name, rule]
            assert r.n_failed == sum(bool(b & bit) for b in bits)
            assert r.n_only == sum(b & p.mask == bit for b in bits)
            assert r.n_kept == sum(b & p.mask == 0 for b in bits)
            assert r.n_kept_without == sum(b & p.mask & ~bit == 0 for b in bits)
    groups = quality.failures_by(book.withColumn("g", book.doc_id % 2), "g").collect()
    assert sum(r.n_docs for r in groups) == len(EDGES)


def test_keep_clean_leaves_columns(documents):
    text = " ".join(f"word{k} plain" for k in range(8)) + "."
    docs = documents(*EDGES, (50, text), (50, text), (None, text))
    kept = quality.keep_clean(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["50", "50", "None"]
    assert kept.first().n_words == "z"


@pytest.mark.parametrize("operator", [quality.ledger, quality.keep_clean])
def test_empty_table(documents, operator):
    assert operator(documents((1, "x")).filter("false")).count() == 0


def test_clean_rows_are_those_of_the_stored_ledger(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    book = quality.stored_ledger(docs)
    assert {r.rules_version for r in book.select("rules_version").distinct().collect()} == {quality.RULES_VERSION}
    clean = {r.doc_id for r in book.filter(quality.kept(quality.CLEAN)).collect()}
    assert 0 < len(clean) < docs.count()
    assert {r.doc_id for r in quality.keep_clean(docs).select("doc_id").collect()} == clean
    one = quality.Policy("one", 1, ("symbols",))
    assert quality.keep_clean(docs, one).count() == book.filter(quality.kept(one)).count()
