from rows import rows_of
from steward.operators import diff

AS_OF = "2024-02-01 00:00:00"
KEY = ("node_id", "id")


def listing(table, *rows):
    return table("node_id string, id string, name string", *rows)


def test_reconcile_equals_its_three_parts_and_settles(catalog, table):
    before = catalog(("a", "x", 5, "local", 3), ("a", "y", 6, "remote", 1), ("b", "x", 7, "local", 2))
    manifest = listing(table, ("a", "x", "renamed"), ("a", "z", "fresh"), ("b", "x", "x.png"))
    feed = diff.reconcile(manifest, before, AS_OF, KEY)
    assert rows_of(feed, "node_id", "id", "name", "size", "status", "change") == [
        ("a", "x", "renamed", 5, "local", "touch"), ("a", "y", "y.png", 6, "remote", "remove"),
        ("a", "z", "fresh", 0, "remote", "add"), ("b", "x", "x.png", 7, "local", "touch"),
    ]
    parts = (
        diff.find_added(manifest, before, AS_OF, KEY)
        .unionByName(diff.find_touched(manifest, before, AS_OF, KEY))
        .unionByName(diff.find_removed(manifest, before, KEY))
    )
    assert rows_of(parts, *feed.columns) == rows_of(feed)
    after = feed.filter("change <> 'remove'").drop("change")
    again = diff.reconcile(manifest, after, AS_OF, KEY)
    assert {r.change for r in again.collect()} == {"touch"}
    assert rows_of(again.drop("change")) == rows_of(after)


def test_reconcile_by_id_takes_the_node_of_the_manifest(catalog, table):
    feed = diff.reconcile(listing(table, ("b", "z", "n")), catalog(("a", "x", 1, "local", 1)), AS_OF)
    assert rows_of(feed, "node_id", "id", "change") == [("a", "x", "remove"), ("b", "z", "add")]


def test_reconcile_shuffles_each_side_once(catalog, table):
    before = catalog(("a", "x", 5, "local", 3))
    manifest = listing(table, ("a", "x", "renamed"))
    feed = diff.reconcile(manifest, before, AS_OF, KEY)
    plan = feed._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FullOuter") == 1
    executed = feed._jdf.queryExecution().executedPlan().toString()
    assert executed.count("Exchange hashpartitioning") == 2


def test_snapshot_diff_carries_old_into_new(table):
    schema = "id string, name string, line_no int"
    old = table(schema, ("x", "x1", 1), ("y", "y1", 2), ("x", "x2", 3))
    new = table(schema, ("x", "x9", 1), ("z", "z1", 2), ("z", "z2", 5))
    net = diff.snapshot_diff(old, new, ["line_no"])
    assert rows_of(net, "id", "name", "change") == [("y", "y1", "remove"), ("z", "z2", "add")]
    # Dropping one of two copies of an id is no change, though a patch would say removed.
    assert diff.snapshot_diff(old, old.filter("line_no > 1"), ["line_no"]).isEmpty()


def test_apply_feed(catalog, table):
    before = catalog(("a", "x", 5, "local", 3), ("a", "y", 6, "local", 1), ("a", "w", 1, "remote", 0))
    net = table(
        "node_id string, id string, name string, change string",
        ("a", "x", "again", "add"), ("a", "y", "y", "remove"), ("a", "z", "z", "add"), ("a", "q", "q", "remove"),
    )
    after = diff.apply_feed(before, net, AS_OF, KEY)
    assert rows_of(after, "id", "name", "size", "status") == [
        ("w", "w.png", 1, "remote"), ("x", "again", 0, "remote"), ("z", "z", 0, "remote"),
    ]
    kept = diff.apply_feed(before, net, AS_OF, KEY, preserve=True)
    assert rows_of(kept.filter("id = 'x'"), "size", "status") == [(5, "local")]


def test_merged_feed_splits_again(catalog, table):
    before = catalog(("a", "x", 5, "local", 3))
    manifest = listing(table, ("a", "z", "fresh"))
    feed = diff.merge_feed(
        diff.find_added(manifest, before, AS_OF), diff.find_removed(manifest, before)
    )
    adds, removes = diff.change_class(feed)
    assert rows_of(adds, "id") == [("z",)] and rows_of(removes, "id") == [("x",)]
