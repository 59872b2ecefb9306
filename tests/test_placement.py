import random

import pytest

from rows import rows_of
from steward.operators import placement

CANDIDATE = "node_id string, id string, replications int, size bigint"
ROOM = "node_id string, room bigint"


def greedy(candidates, rooms):
    """File by file, as a plain loop."""
    left, fits = dict(rooms), {}
    for node, id_, _, size in sorted(candidates, key=lambda c: (c[0], c[2], c[1])):
        fits[node, id_] = size < left.get(node, 0)
        if fits[node, id_]:
            left[node] -= size
    return fits


def fitted(table, candidates, rooms, **options):
    out = placement.fit_capacity(table(CANDIDATE, *candidates), table(ROOM, *rooms), **options)
    assert out.columns == ["node_id", "id", "replications", "size", "fits"]
    return {(r.node_id, r.id): r.fits for r in out.collect()}


def test_a_file_of_just_the_room_does_not_fit_and_the_next_is_tried(table):
    files = [("a", "1", 1, 10), ("a", "2", 1, 4), ("a", "3", 2, 6), ("a", "4", 3, 5), ("x", "1", 1, 1)]
    for rows in (100, 0):
        got = fitted(table, files, [("a", 10)], group_rows=rows)
        assert got == {("a", "1"): False, ("a", "2"): True, ("a", "3"): False, ("a", "4"): True, ("x", "1"): False}


def cases():
    rng = random.Random(11)
    sizes = {
        "wide": lambda: 2 ** rng.randrange(12) + rng.randrange(5),
        "equal": lambda: 7,
        "tiny": lambda: rng.randrange(3),
        "near": lambda: rng.randrange(90, 110),
        "falling": iter(range(400, 0, -1)).__next__,
    }
    candidates = [
        (node, f"{i:03d}", rng.randrange(1, 5), size()) for node, size in sizes.items() for i in range(120)
    ]
    rooms = [("wide", 3000), ("equal", 100), ("tiny", 60), ("near", 555), ("falling", 1000), ("idle", 5)]
    return candidates, rooms


# All nodes walked; slices of one file, of a few, and of a third of a node.
@pytest.mark.parametrize("group_rows", [1000, 0, 7, 40])
def test_walk_and_rounds_match_a_plain_loop(table, group_rows):
    candidates, rooms = cases()
    got = fitted(table, candidates, rooms, group_rows=group_rows)
    assert got == greedy(candidates, rooms)
    for node, room in rooms:
        assert sum(s for n, i, _, s in candidates if n == node and got[n, i]) < room
    assert 0 < sum(got.values()) < len(got)


def test_rounds_open_few_slices(table):
    rng = random.Random(3)
    files = [("a", f"{i:05d}", 1, int(2 ** rng.uniform(0, 30))) for i in range(3000)]
    placed = table(CANDIDATE + ", _room bigint", *[(*f, 1 << 31) for f in files])
    opened = []
    rows = placement._rounds(placed, placement.NEED_ORDER, 20, opened).collect()
    assert {(r.node_id, r.id): r.fits for r in rows} == greedy(files, [("a", 1 << 31)])
    assert len(opened) <= 32 and max(opened) <= 120 and sum(opened) < len(files) / 2, opened


@pytest.mark.parametrize("seed", range(30))
def test_the_index_tells_where_the_room_leaves_its_class(seed):
    import numpy as np

    rng = random.Random(seed)
    top = rng.choice([3, 10, 40, 62])
    sizes = [int(2 ** rng.uniform(0, top)) - rng.randint(0, 1) for _ in range(200)]
    width, room, taken = rng.choice([1, 3, 16]), int(2 ** rng.uniform(0, top + 0.9)), []
    slices = [sizes[k : k + width] for k in range(0, len(sizes), width)]
    index = [(n, *row) for n, part in enumerate(slices) for row in placement.index_of(np.array(part, dtype=np.int64))]
    start, events, left = 0, 0, room
    while True:
        spans, at, left = placement.next_event(index, left, start)
        for first, end, cut in spans:
            taken += [size < cut for part in slices[first:end] for size in part]
        if at is None:
            break
        fits = placement.first_fit(slices[at], left)
        taken += fits
        left -= sum(s for s, f in zip(slices[at], fits) if f)
        start, events = at + 1, events + 1
    assert taken == placement.first_fit(sizes, room) and events <= 63


def test_size_classes():
    import numpy as np

    sizes = [0, 1, 2, 3, 4, 7, 8, (1 << 53) + 1, (1 << 62) - 1, 1 << 62, (1 << 63) - 1]
    assert placement.size_class(np.array(sizes, dtype=np.int64)).tolist() == [s.bit_length() for s in sizes]


def test_prefix_counts_skipped_files(table):
    files = [("a", "1", 1, 6), ("a", "2", 1, 5), ("a", "3", 2, 3), ("a", "4", 2, 50)]
    got = fitted(table, files, [("a", 10)], mode="prefix")
    assert got == {("a", "1"): True, ("a", "2"): False, ("a", "3"): False, ("a", "4"): False}
    greedy_fit = fitted(table, files, [("a", 10)])
    assert greedy_fit["a", "3"] and not greedy_fit["a", "2"]


def test_unknown_mode(table):
    with pytest.raises(ValueError):
        fitted(table, [("a", "1", 1, 1)], [("a", 1)], mode="best")


def test_used_bytes_and_sizes(catalog, table):
    files = catalog(("a", "x", 5, "local", 1), ("a", "y", 6, "remote", 1), ("b", "z", 7, "remote", 1))
    assert rows_of(placement.used_bytes(files)) == [("a", 5), ("b", 0)]
    room = placement.node_room(
        table("node_id string, max_bytes bigint", ("a", 20), ("c", 9)), placement.used_bytes(files)
    )
    assert rows_of(room) == [("a", 15), ("c", 9)]
    objects = table("id string, size bigint", ("x", 3), ("x", 3), ("y", None))
    sized = {r.id: r.object_size for r in placement.attach_sizes(files, objects).collect()}
    assert sized == {"x": 3, "y": None, "z": None}


def test_small_groups_share_calls_and_are_cut_nowhere():
    import pyarrow as pa

    rng = random.Random(5)
    keys = [k for k in range(500) for _ in range(rng.choice([1, 2, 3, 40]))]
    rows = pa.table({"node_id": [str(k) for k in keys], "slice": [k % 7 for k in keys], "at": list(range(len(keys)))})
    for width in (1, 3, 64, 100_000):
        calls, seen = 0, []

        def step(table, groups):
            nonlocal calls
            calls += 1
            at = table.column("at").to_pylist()
            seen.extend(at[a:b] for a, b in groups)
            return table

        batches = rows.to_batches(max_chunksize=width)
        empty = rows.schema.empty_table().to_batches() or [pa.RecordBatch.from_pylist([], rows.schema)]
        out = pa.Table.from_batches(placement._whole_groups(iter([*empty, *batches, *empty]), ["node_id", "slice"], step))
        assert out.equals(rows) and [len(s) for s in seen] == [keys.count(k) for k in range(500)]
        assert calls <= 2 * len(batches)


def test_many_short_nodes_have_no_python_batch_each(table):
    files = [(f"n{n}", f"{i}", i % 3, 1 + (n * i) % 5) for n in range(60) for i in range(5)]
    rooms = [(f"n{n}", 6) for n in range(60)]
    assert fitted(table, files, rooms, group_rows=2) == greedy(files, rooms) == fitted(table, files, rooms)
    plan = placement.fit_capacity(table(CANDIDATE, *files), table(ROOM, *rooms))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
