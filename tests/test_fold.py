import random

import pytest

from rows import rows_of
from steward.operators.fold import fold_changes

SCHEMA = "seq bigint, id string, op string, name string"
OPS = {"+": "add", "-": "remove"}


def walk(lines):
    """Line by line, as a plain loop."""
    state, name = 0, None
    for op, line in lines:
        step = 1 if op == "+" else -1
        if state == 0:
            state, name = step, line
        elif state == -step:
            state, name = 0, None
    return state, name


TRUTH = {
    "+": ("add", "0"), "-": ("remove", "0"), "++": ("add", "0"), "--": ("remove", "0"),
    "+-": None, "-+": None, "++-": None, "++--": ("remove", "3"), "--+": None,
    "--++": ("add", "3"), "+-+": ("add", "2"), "-++": ("add", "2"), "+--+++": ("add", "4"),
}


@pytest.mark.parametrize("chunk", [1 << 18, 3, 2])
def test_truth_table(table, chunk):
    feed = table(SCHEMA, *[(i, ops, OPS[o], str(i)) for ops in TRUTH for i, o in enumerate(ops)])
    got = {r.id: (r.change, r["name"]) for r in fold_changes(feed, chunk=chunk).collect()}
    assert got == {ops: end for ops, end in TRUTH.items() if end}


@pytest.mark.parametrize("chunk", [1 << 18, 7, 2])
def test_random_feeds_match_a_plain_walk(table, chunk):
    rng = random.Random(chunk)
    # One id takes a third of all lines.
    lines = [
        (seq, "hot" if rng.random() < 0.33 else f"id{rng.randrange(40)}", rng.choice("+-"))
        for seq in rng.sample(range(5000), 900)
    ]
    per_id = {}
    for seq, id_, op in sorted(lines):
        per_id.setdefault(id_, []).append((op, f"n{seq}"))
    want = {i: walk(v) for i, v in per_id.items()}
    feed = table(SCHEMA, *[(s, i, OPS[o], f"n{s}") for s, i, o in lines])
    got = fold_changes(feed, chunk=chunk, keep_none=True).collect()
    names = {"add": 1, "remove": -1, "none": 0}
    assert {r.id: (names[r.change], r["name"]) for r in got} == want


def test_rename_nets_to_nothing_and_other_tags_are_ignored(table):
    feed = table(
        SCHEMA, (0, "x", "remove", "old"), (1, "x", "add", "new"), (2, "y", "context", "c")
    )
    assert fold_changes(feed).isEmpty()


def test_order_of_several_columns(table):
    feed = table(
        "path string, block_start bigint, k bigint, id string, op string, name string",
        ("b", 0, 1, "x", "add", "late"), ("a", 10, 9, "x", "remove", "mid"), ("a", 2, 30, "x", "add", "early"),
    )
    got = fold_changes(feed, ("path", "block_start", "k"))
    assert rows_of(got, "id", "change", "name") == [("x", "add", "late")]


def test_a_hot_id_over_hundreds_of_blocks(spark, monkeypatch):
    """Three files of 200 blocks each; no group that is collected outgrows a chunk."""
    import random

    from pyspark.sql import functions as F

    from steward.operators import fold

    draw = random.Random(5)
    rows = []
    for path in ("a", "b", "c"):
        for block in range(200):
            for k in range(draw.randint(1, 5)):
                rows.append((path, block, k, "hot" if draw.random() < 0.9 else f"cold{draw.randint(0, 9)}", draw.choice(["add", "remove"]), f"{path}{block}-{k}"))
    ordered, calls = fold._ordered, []

    def watched(columns, *payload):
        items = ordered(columns, *payload)
        calls.append(columns)
        return F.when(F.size(items) <= 8, items)  # a larger group would be lost

    monkeypatch.setattr(fold, "_ordered", watched)
    feed = spark.createDataFrame(rows, "path string, block_start bigint, k bigint, id string, op string, name string").repartition(7)
    got = {r.id: (r.change, r["name"]) for r in fold.fold_changes(feed, ("path", "block_start", "k"), chunk=8, keep_none=True).collect()}
    assert len(calls) >= 4  # lines, two levels above them, and the last
    want = {}
    for _, _, _, id_, op, name in sorted(rows):
        at, kept = want.get(id_, (0, None))
        moved = max(-1, min(1, at + (1 if op == "add" else -1)))
        want[id_] = (moved, name if at == 0 else kept if moved == at else None)
    assert got == {i: ({1: "add", -1: "remove", 0: "none"}[at], name) for i, (at, name) in want.items()}
