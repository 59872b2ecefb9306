from itertools import pairwise
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from steward.llm import grammar
from steward.llm.queries import QUERIES, WORD_LEVEL
from steward.llm.shared import batches_by_bytes

END = 1


def shards_of(files):
    return [
        (r, grammar.Shard.read(r["first"], r["rules"], r["lengths"], r["symbols"]))
        for r in sorted(files.collect(), key=lambda r: (r.part, r.shard))
    ]


@pytest.mark.parametrize("seed", range(4))
def test_compress_and_decode_anywhere(seed):
    rng = np.random.default_rng(seed)
    words = [rng.integers(2, 40, rng.integers(1, 9)) for _ in range(30)]
    ids = np.concatenate([np.append(np.concatenate([words[k] for k in rng.integers(0, 30, 40)]), END) for _ in range(30)])
    rules, symbols = grammar.compress(ids, END, 100, least=4)
    assert len(symbols) < 0.6 * len(ids) and len(rules)
    assert END not in rules
    shard = grammar.Shard(100, rules, grammar.lengths_of(rules, 100), symbols)
    assert np.array_equal(shard.decode(), ids)
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(ids) + 5, 2).tolist())
        assert np.array_equal(shard.decode(a, b), ids[a:b])


def counted(symbols):
    """Occurrences of each pair, those of one run of a symbol without overlaps."""
    found, i, last = {}, 0, None
    for a, b in pairwise(symbols):
        i += 1
        if END in (a, b) or (a == b and last == (a, i - 1)):
            continue
        last = (a, i) if a == b else None
        found[a, b] = found.get((a, b), 0) + 1
    return found


def repair(ids, first, least):
    """Re-Pair in rounds, written plainly: one pass over the symbols per pair."""
    rules, now = [], list(ids)
    while frequent := {p: n for p, n in counted(now).items() if n >= least}:
        lefts, rights, taken = set(), set(), []
        for a, b in sorted(frequent, key=lambda p: (-frequent[p], p)):
            if a not in rights and b not in lefts:
                lefts.add(a)
                rights.add(b)
                taken.append((a, b))
        for pair in taken:
            out, i = [], 0
            while i < len(now):
                if tuple(now[i : i + 2]) == pair:
                    out.append(first + len(rules))
                    i += 2
                else:
                    out.append(now[i])
                    i += 1
            now = out
            rules.append(pair)
    return rules, now


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("least", [2, 4])
def test_as_plain_rounds(seed, least):
    rng = np.random.default_rng(seed)
    kinds, size = int(rng.integers(1, 12)), int(rng.integers(0, 600))
    ids = rng.choice([END, *range(2, 2 + kinds)], size)
    ids = np.repeat(ids, rng.integers(1, 5, size)) if seed % 2 else ids
    rules, symbols = grammar.compress(ids, END, 20, least=least)
    plain_rules, plain_symbols = repair(ids.tolist(), 20, least)
    assert list(map(tuple, rules.tolist())) == plain_rules
    assert symbols.tolist() == plain_symbols
    assert all(n < least for n in counted(plain_symbols).values())
    shard = grammar.Shard(20, rules, grammar.lengths_of(rules, 20), symbols)
    assert np.array_equal(shard.decode(), ids)


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(3)
    passage = rng.integers(2, 5000, 100)
    ids = np.concatenate([np.minimum(rng.zipf(1.3, 60_000) + 1, 5000), *[passage] * 20, [END]])
    rules, symbols = grammar.compress(ids, END, 5001)
    assert max(counted(symbols.tolist()).values()) < grammar.LEAST_COUNT
    assert grammar.lengths_of(rules, 5001).max() > 16


def test_equal_ids_halve():
    rules, symbols = grammar.compress(np.append(np.full(4096, 7), END), END, 10)
    assert len(rules) == 10 and len(symbols) == 5


def test_each_symbol_is_expanded_once(monkeypatch):
    ids = np.append(np.tile(np.arange(2, 30), 40), END)
    rules, symbols = grammar.compress(np.tile(ids, 8), END, 100)
    shard = grammar.Shard(100, rules, grammar.lengths_of(rules, 100), symbols)
    given, expand = [], grammar.Shard._expand
    monkeypatch.setattr(grammar.Shard, "_expand", lambda self, s: (given.append(s), expand(self, s))[1])
    assert np.array_equal(shard.decode(), np.tile(ids, 8))
    assert all(len(np.unique(s)) == len(s) for s in given) and len(given[0]) < len(symbols)


def test_pairs_without_room_for_their_places_are_ordered_alike():
    rng = np.random.default_rng(5)
    pairs, places = rng.integers(0, 9, 500), rng.permutation(500)
    packed, at = grammar._ordered(pairs, places, 9)
    wide, at_wide = grammar._ordered(pairs + (1 << 60), places, 9)
    assert np.array_equal(packed, wide - (1 << 60)) and np.array_equal(at, at_wide)
    assert np.array_equal(packed, np.sort(pairs)) and np.array_equal(pairs[np.argsort(places)][at], packed)


@pytest.mark.parametrize("ids", [[], [END], [4], [4, 4, 4, 4], [END] * 9])
def test_small_inputs(ids):
    ids = np.array(ids, dtype=np.int64)
    rules, symbols = grammar.compress(ids, END, 10, least=1)
    assert np.array_equal(grammar.Shard(10, rules, grammar.lengths_of(rules, 10), symbols).decode(), ids)


def test_joined_checksums():
    data = bytes(range(256)) * 37
    for cuts in ([0, len(data)], [0, 5, 5, 900, len(data)]):
        parts = [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        assert grammar.joined_crc32((crc32(p), len(p)) for p in parts) == crc32(data)


def expected(rows):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.append(library.encode(text or "", add_special_tokens=False).ids, END).astype("<u4")
        out.append((i, start, len(ids), crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op6_token_files"](spark, sf).collect()))
    assert got == expected(docs)


@pytest.mark.parametrize("shard_tokens", [7, 1000])
def test_documents_longer_than_a_shard(spark, documents, tmp_path, shard_tokens):
    rows = [(5, "short one"), (1, None), (2, ""), (9, "many words here " * 400), (3, "tie"), (4, "tie"), (None, "no id"), (6, 'a " quote'), (7, "x <|endoftext|> y")]
    path = str(tmp_path / "files")
    grammar.write(documents(*rows), path, WORD_LEVEL, END, shard_tokens=shard_tokens)
    got = sorted(map(tuple, grammar.read(spark, path).collect()), key=lambda r: r[1])
    assert got == expected(rows)
    files = shards_of(spark.read.parquet(path))
    assert all(r.n_tokens <= shard_tokens and len(s.decode()) == r.n_tokens for r, s in files)


def test_slices_end_by_bytes():
    texts = ["ab", None, "é", "x" * 9, "", "abc", "y" * 20]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["id", "text"])
    slices = [b.column(1).to_pylist() for b in batches_by_bytes(batch, 1, 6)]
    assert slices == [["ab", None, "é"], ["x" * 9], ["", "abc"], ["y" * 20]]
    assert not list(batches_by_bytes(batch.slice(0, 0), 1, 6))


def test_repeated_rows_and_no_rows(spark, documents, tmp_path):
    docs = documents((1, "same text"), (1, "same text"), (None, "same text"), (None, "same text"))
    grammar.write(docs, str(tmp_path / "a"), WORD_LEVEL, END)
    rows = grammar.read(spark, str(tmp_path / "a")).collect()
    assert sorted(r.start for r in rows) == [0, 3, 6, 9] and len({r.ids_crc32 for r in rows}) == 1
    grammar.write(docs.filter("false"), str(tmp_path / "b"), WORD_LEVEL, END)
    assert grammar.read(spark, str(tmp_path / "b")).count() == 0
