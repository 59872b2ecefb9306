import re
from itertools import pairwise

import numpy as np
import pytest
import xxhash

from steward.llm import pieces
from steward.llm.queries import PIECES, QUERIES

TEXTS = [
    "", " ", "   ", "a", "a  b", " lead", "trail  ", "It's déjà vu, \n\n\tStraße.", "日本語 テキスト", "mark ▁ and ▁▁x", "\0 nul",
    "emoji 🙂🙂", "<s> <unk> </s>", "x" * 300, "ab" * 200 + " c", "é combining", "1234567890" * 3,
]


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PIECES)


def test_without_dropout_as_the_library(model, spark, sf):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40).collect()]
    for t in texts:
        if "▁" not in t and "\0" not in t:
            assert model.encode(t).tolist() == model.library.encode(t), t


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_lossless(model, rate):
    for k, t in enumerate(TEXTS):
        for seed in range(3):
            ids = model.encode(t, rate, seed, k)
            assert model.decode(ids) == t
            assert np.array_equal(ids, pieces.Pieces.encode(model, t, rate, seed, k))


def test_seeds_and_documents_vary_and_are_repeatable(model):
    text = "internationalization of tokenizers " * 20
    made = {(s, d): tuple(model.encode(text, 0.2, s, d).tolist()) for s in range(3) for d in range(3)}
    assert len(set(made.values())) == 9
    again = pieces.Pieces(PIECES)
    assert all(tuple(again.encode(text, 0.2, s, d).tolist()) == v for (s, d), v in made.items())
    plain = len(model.encode(text))
    assert plain < len(made[0, 0]) < len(model.encode(text, 1.0))
    assert len(model.encode(text, 1.0)) == len(text.replace(" ", "▁")) + 1


def test_both_agendas_agree(model):
    rng = np.random.default_rng(0)
    for _ in range(300):
        word = "▁" + "".join(rng.choice(list("abcdetinorsth"), rng.integers(1, 30)))
        bar, key = int(rng.choice([0, 2**29, 2**31])), int(rng.integers(2**32))
        assert model._merged(list(word), bar, key) == model._merged_long(list(word), bar, key)


def test_many_words_at_a_time_agree_with_one(model):
    rng = np.random.default_rng(1)
    letters = list("abcdetinorsth é日\n\0😀")
    words = [" " + "".join(rng.choice(letters, rng.integers(0, 20))) for _ in range(400)]
    keys = rng.integers(2**32, size=len(words)).tolist()
    for rate in (0.0, 0.1, 0.7):
        found = model._merged_many(words, int(rate * 2**32), keys)
        one = [np.array(model.segment(w, rate, k), dtype="<u4").tobytes() for w, k in zip(words, keys, strict=True)]
        assert found == one


def plain_dropout(model, text, rate, seed, doc):
    """Merge-dropout written plainly, a word and a merge at a time."""
    library, ids = model.library, []
    usual = {library.id_to_piece(i) for i in range(library.get_piece_size()) if not library.is_byte(i) and not library.is_control(i) and not library.is_unknown(i)}
    order = sorted(usual, key=lambda p: (-library.get_score(library.piece_to_id(p)), library.piece_to_id(p)))
    rank = {p: r for r, p in enumerate(order) if len(p) > 1}
    start = xxhash.xxh64_intdigest(str(doc).encode(), seed)
    for k, word in enumerate(re.findall(" *[^ ]+| +", " " + text) if text else []):
        x = (start + k * 0x9E3779B97F4A7C15) % 2**64
        key = (((x ^ x >> 30) * 0xBF58476D1CE4E5B9) % 2**64) >> 32
        word = word.replace(" ", "▁")
        cuts, barred = list(range(len(word) + 1)), set()
        while True:
            spans = [s for s in zip(cuts, cuts[1:], cuts[2:], strict=False) if s not in barred and word[s[0] : s[2]] in rank]
            if not spans:
                break
            best = min(spans, key=lambda s: (rank[word[s[0] : s[2]]], s[0]))
            if pieces._skipped(key, best[0], rank[word[best[0] : best[2]]], int(rate * 2**32)):
                barred.add(best)
            else:
                cuts.remove(best[1])
        for a, b in pairwise(cuts):
            known = word[a:b] in usual
            ids += [library.piece_to_id(word[a:b])] if known else [library.piece_to_id(f"<0x{v:02X}>") for v in word[a:b].encode()]
    return ids


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_against_plain_dropout(model, spark, sf, rate):
    texts = [t for t in TEXTS if "▁" not in t and "\0" not in t]
    texts += [r.text[:1500] for r in spark.read.parquet(f"{sf}/documents.parquet").filter("text is not null").select("text").limit(6).collect()]
    found = model.encode_many(list(enumerate(texts)), rate, 7)
    for k, t in enumerate(texts):
        assert found[k].tolist() == plain_dropout(model, t, rate, 7, k), t


def test_every_occurrence_has_draws_of_its_own(model):
    word, n = " internationalization", 4000
    ids = model.encode((word * n)[1:], 0.3, 3, 9)
    spelled = [model.library.id_to_piece(i) for i in ids.tolist()]
    assert "".join(spelled) == (word * n).replace(" ", "▁")
    found, now = [], []
    for piece in spelled:
        if piece.startswith("▁") and now:
            found.append(tuple(now))
            now = []
        now.append(piece)
    found.append(tuple(now))
    assert len(found) == n and len(set(found)) > 100
    whole = [f for f in found if f == tuple(p.replace(" ", "▁") for p in map(model.library.id_to_piece, model.encode(word[1:]).tolist()))]
    assert 0 < len(whole) < n / 2


def test_share_of_skipped_merges():
    found = [pieces._skipped(k * 7919, p, m, int(0.1 * 2**32)) for k in range(40) for p in range(10) for m in range(0, 4000, 97)]
    assert abs(np.mean(found) - 0.1) < 0.01


def test_forgetting_changes_nothing(model, monkeypatch):
    want = model.encode("some words and some more words", 0.3, 5, 1).tolist()
    monkeypatch.setattr(pieces, "LEAVES_KEPT", 2)
    monkeypatch.setattr(pieces, "_WORDS", 3)
    assert pieces.Pieces(PIECES).encode("some words and some more words", 0.3, 5, 1).tolist() == want


def test_operators(documents):
    rows = [(1, None), (2, ""), (3, "tie"), (3, "tie"), (None, "tie"), (4, "long text " * 20_000), (5, "a ▁ b")]
    docs = documents(*rows)
    encoded = pieces.encode(docs, PIECES)
    back = pieces.decode(encoded, PIECES).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in back))) == sorted(map(repr, rows))
    assert {r.n_tokens for r in back if r.doc_id in (1, 2)} == {0}
    assert pieces.encode(docs.filter("false"), PIECES).count() == 0
    assert pieces.round_trip(docs.filter("false"), PIECES).count() == 0


def test_whole_table(spark, sf):
    from zlib import crc32

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op10_piece_dropout"](spark, sf).collect()
    assert len(rows) == len(docs) and all(r.lossless for r in rows)
    assert all(r.text_crc32 == crc32(docs[r.doc_id].encode()) for r in rows)
