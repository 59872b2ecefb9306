import dataclasses

import pytest
from pyspark.sql import functions as F

from rows import rows_of
from steward.operators import nodes as node_ops
from steward.plans import adder as adding
from steward.plans import evict, sync

AS_OF = "2024-02-01 00:00:00"
PROVIDER = "id string, peer_id string, seen_at timestamp, ok boolean"
EVERY = {"lookup_failed", "no_action", "not_drawn", "size_unknown", "no_room", "pull"}


@pytest.fixture()
def world(catalog, table):
    """Sixty rare files on one node, and files for each way a decision can go."""
    rare = [f"r{i}" for i in range(60)]
    files = [("a", i, 0, "remote", 0) for i in [*rare, "nobody", "many", "failed", "unsized"]]
    stored = [("a", "kept", 400, "local", 1)]
    seen = [(i, "p1", None, True) for i in [*rare, "unsized"]]
    seen += [("many", f"p{i}", None, True) for i in range(5)] + [("failed", "p1", None, False)]
    sizes = [(i, 100) for i in [*rare, "nobody", "many", "failed"]] + [("unsized", None)]
    return sync.Observed(
        table(PROVIDER, *seen),
        table("id string, size bigint", *sizes),
        table("node_id string, max_bytes bigint", ("a", 1500)),
        5,
        AS_OF,
        seed=1,
    ), catalog(*files, *stored)


def outcomes_of(world, **options):
    seen, files = world
    remote = files.filter("status = 'remote'")
    return adding.adder(
        remote, files, seen.providers, seen.objects, seen.nodes, 5, seen.seed, seen.run, **options
    )


def test_adder_reaches_every_outcome_and_applies_it(world):
    seen, files = world
    # One of the two must be drawn for its size to matter.
    out = outcomes_of(world)
    got = {r.id: r for r in out.collect()}
    kinds = {r.outcome for r in got.values()}
    assert kinds | {"size_unknown"} == EVERY
    assert got["failed"].outcome == "lookup_failed"
    assert got["many"].outcome == got["nobody"].outcome == "no_action"
    drawn = got["unsized"].draw > got["unsized"].energy
    assert got["unsized"].outcome == ("size_unknown" if drawn else "not_drawn")
    pulls = [r for r in got.values() if r.outcome == "pull"]
    # 400 stored, 1500 allowed: ten files of 100 leave room for one of exactly 100, which is too large.
    assert len(pulls) == 10 and all(r.draw > r.energy for r in pulls)
    assert all(r.draw <= r.energy for r in got.values() if r.outcome == "not_drawn")

    after = {r.id: r for r in adding.apply_outcomes(files, out, AS_OF).catalog.collect()}
    for id_, row in got.items():
        now = after[id_]
        if row.outcome in ("lookup_failed", "no_room", "size_unknown"):
            assert (now.replications, now.status, now.modified.month) == (0, "remote", 1)
        else:
            assert (now.replications, now.modified.month) == (row.replications, 2)
            assert (now.status, now.size) == (("local", 100) if row.outcome == "pull" else ("remote", 0))
    assert after["kept"].modified.month == 1


def test_adder_in_rounds_agrees(world):
    assert rows_of(outcomes_of(world), "id", "outcome") == rows_of(
        outcomes_of(world, group_rows=0), "id", "outcome"
    )


def test_rebalance_keeps_within_the_limit(world):
    seen, files = world
    after, out = adding.rebalance(
        files, seen.providers, seen.objects, seen.nodes, 5, AS_OF, seed=1, run=0
    )
    stored = after.filter("status = 'local'").agg(F.sum("size")).first()[0]
    assert stored < 1500 and out.count() == 64 and after.count() == files.count()


def test_full_sync(world, table):
    seen, files = world
    lines = table(
        "node_id string, id string, name string, n int",
        ("a", "r1", "old", 1), ("a", "r1", "new", 2), ("a", "brand", "brand", 3), ("a", "r2", "r2.png", 4),
    )
    done = sync.sync_full(lines, files, seen, ("n",))
    assert rows_of(done.catalog, "id", "name") == [("brand", "brand"), ("r1", "new"), ("r2", "r2.png")]
    assert rows_of(done.unpin) == [("a", "kept")]
    assert rows_of(done.outcomes, "id", "outcome") == [("brand", "no_action")]
    pins = table(
        "node_id string, cid string, pin_type string",
        ("a", "kept", "recursive"), ("a", "r2", "recursive"), ("b", "r2", "recursive"),
    )
    blocks = table(
        "node_id string, cid string",
        *[(n, c) for n in "ab" for c in ("kept", "kept-1", "r2", "r2-1", "stray")],
    )
    links = table("parent string, child string", ("kept", "kept-1"), ("r2", "r2-1"))
    assert rows_of(sync.sweep_after(done, blocks, links, pins), "node_id", "cid") == [
        ("a", "kept"), ("a", "kept-1"), ("a", "stray"), ("b", "kept"), ("b", "kept-1"), ("b", "stray"),
    ]


def test_incremental_sync(world, table):
    seen, files = world
    patch = table(
        "node_id string, id string, op string, name string, seq bigint",
        ("a", "kept", "remove", "kept", 1), ("a", "r3", "add", "again", 2),
        ("a", "fresh", "add", "fresh", 3), ("a", "gone", "add", "gone", 4), ("a", "gone", "remove", "gone", 5),
    )
    done = sync.sync_incremental(patch, files, seen, ("seq",))
    got = {r.id: r["name"] for r in done.catalog.collect()}
    assert "kept" not in got and "gone" not in got
    assert (got["fresh"], got["r3"], len(got)) == ("fresh", "again", 65)
    assert rows_of(done.unpin) == [("a", "kept")]
    assert {r.id for r in done.outcomes.collect()} == {"r3", "fresh"}
    # An equal checkpoint leads to an empty feed, and that to no change.
    same = sync.sync_incremental(patch.filter("false"), files, seen, ("seq",))
    assert rows_of(same.catalog) == rows_of(files) and same.outcomes.isEmpty()


def test_each_manifest_has_its_own_factor(world, table):
    """With one holder a file is rare under a factor of 5, and enough under a factor of 1."""
    seen, files = world
    seen = dataclasses.replace(seen, threshold=F.col("threshold"))
    before = files.filter("id = 'kept'")
    low = [f"r{i}" for i in range(30)]
    high = [f"r{i}" for i in range(30, 60)]
    listed = [("a", i, i, 1, 1) for i in low] + [("a", i, i, 2, 5) for i in high]
    lines = table(
        "node_id string, id string, name string, n int, threshold int",
        ("a", "kept", "kept", 1, 5), ("a", "r0", "r0", 0, 5), *listed,
    )
    changes = lines.filter("id <> 'kept'").withColumn("op", F.lit("add"))
    for done in (
        sync.sync_full(lines, before, seen, ("n",)),
        sync.sync_incremental(changes, before, seen, ("n",)),
    ):
        got = {r.id: r.outcome for r in done.outcomes.collect()}
        assert len(got) == 60 and {got[i] for i in low} == {"no_action"}
        assert "pull" in {got[i] for i in high} <= {"pull", "not_drawn", "no_room"}
        assert done.catalog.count() == 61


def test_evict_and_swap(catalog, table):
    nodes = table("node_id string", *[(f"n{i}",) for i in range(20)])
    files = catalog(
        ("a", "best", 50, "local", 9), ("a", "good", 50, "local", 5), ("a", "rare", 50, "local", 2),
        ("b", "only", 10, "local", 7), ("c", "far", 10, "remote", 9),
    )
    evictable = evict.evict_candidates(files, nodes)
    assert rows_of(evictable, "id") == [("best",), ("good",), ("only",)]
    wanted = table(
        "node_id string, id string, replications int, size bigint",
        ("a", "w1", 1, 30), ("a", "w2", 1, 30), ("a", "w3", 2, 10), ("b", "w1", 1, 100), ("c", "w1", 1, 1),
    )
    rooms = table("node_id string, room bigint", ("a", 0), ("b", 0), ("c", 100))
    plan = evict.swap_plan(evictable.drop("name"), wanted, rooms)
    assert rows_of(plan, "node_id", "id", "action") == [
        ("a", "best", "evict"), ("a", "w1", "pull"), ("a", "w3", "pull"),
    ]


def test_reports(catalog, table, spark, tmp_path):
    from steward.sources import tables

    schema = "node_id string, email string, `limit` string, disk_total bigint, disk_free bigint, initialised boolean"
    nodes = table(
        schema,
        ("a", "a@x.org", "50GB", 10**12, 5, True), ("b", "b@x.org", "2TB", 10**12, 5, False),
        ("c", "c@x.org", "plenty", 10**12, 5, True),
    )
    used = table("node_id string, used bigint", ("a", 1_500_000_000))
    reports = node_ops.usage_report(nodes, used)
    assert rows_of(reports) == [("a", "a@x.org", 50.0, 1.5), ("b", "b@x.org", 1000.0, 0.0)]
    assert rows_of(node_ops.bad_limits(nodes), "node_id") == [("c",)]
    limits = {r.node_id: (r.limit_bytes, r.max_bytes) for r in node_ops.with_limits(nodes).collect()}
    assert limits == {"a": (50 * 10**9, 50 * 10**9), "b": (2 * 10**12, 5), "c": (None, None)}
    tables.write_reports(reports, str(tmp_path / "out"))
    messages = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert '{"email":"a@x.org","total_space":50.0,"used_space":1.5}' in messages and len(messages) == 2
