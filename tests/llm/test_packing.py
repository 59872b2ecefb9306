from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from steward.llm import packing
from steward.llm.queries import BYTE_LEVEL, QUERIES


def checked(rows, size=1024):
    """Pieces by document and the lengths of sequences, after the rules of packing."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
    return docs, {s: sum(r.length for r in p) for s, p in sequences.items()}


def test_every_id_once_and_little_padding(spark, sf):
    rows = QUERIES["op3_packing"](spark, sf).collect()
    docs, lengths = checked(rows)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n = len(library.encode(d.text, add_special_tokens=False).ids) + 1
        at = 0
        for r in sorted(docs[d.doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == n
            at += r.length
        assert at == n
    assert sum(1024 - n for n in lengths.values()) < 1024


def test_ids_come_back(documents):
    long = " ".join(f"word{k}" for k in range(9000))
    given = [(1, None), (2, ""), (3, "short text"), (4, long), (5, "tie"), (6, "tie"), (7, "x <|endoftext|> y")]
    rows = packing.pack(documents(*given), BYTE_LEVEL, end=0, block=2).collect()
    docs, _ = checked(rows)
    library = Tokenizer.from_file(BYTE_LEVEL)
    for i, text in given:
        ids = b"".join(r.ids for r in sorted(docs[i], key=lambda r: r.start))
        assert ids == np.append(library.encode(text or "", add_special_tokens=False).ids, 0).astype("<u4").tobytes()


def test_repeated_rows_null_ids_and_no_rows(documents):
    rows = packing.pack(documents((1, "same"), (1, "same"), (None, "same")), BYTE_LEVEL, end=0).collect()
    checked(rows)
    assert len(rows) == 3
    assert packing.pack(documents((1, "x")).filter("false"), BYTE_LEVEL, end=0).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_costs_are_level(seed):
    lengths = np.random.default_rng(seed).integers(1, 1024, 400).tolist()
    costs, used = defaultdict(float), defaultdict(int)
    for _, _, part, to, offset in packing.balance(lengths):
        assert offset == used[to]
        used[to] += part
        costs[to] += packing.cost(part)
    assert len(used) == -(-sum(lengths) // 1024) and max(used.values()) <= 1024
    # first fit descending fills one sequence after another with the longest
    spread = np.std(list(costs.values()))
    ordered = sorted(lengths, reverse=True)
    firsts, room = [], []
    for n in ordered:
        for k, left in enumerate(room):
            if left >= n:
                room[k] -= n
                firsts[k] += packing.cost(n)
                break
        else:
            room.append(1024 - n)
            firsts.append(packing.cost(n))
    assert spread < 0.8 * np.std(firsts)


def test_descending_to_the_cheapest_with_room():
    placed = list(packing.balance([300, 700, 400, 600], size=1024))
    assert [p[:4] for p in placed] == [(1, 0, 700, 0), (3, 0, 600, 1), (2, 0, 400, 1), (0, 0, 300, 0)]
