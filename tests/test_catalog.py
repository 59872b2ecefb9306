import datetime
import re

import pytest
from pyspark.sql import functions as F
from rows import rows_of
from steward.operators import catalog as cat
from steward.sources import tables

AS_OF = "2024-02-01 00:00:00"
NOW = datetime.datetime(2024, 2, 1)
FAUX = ("n7", "made-up-for-this-test", 812, "remote", 3)


def ids(table, *values):
    return table("id string", *[(v,) for v in values])


def test_get_no_entry(catalog, table):
    found = cat.lookup(catalog(), ids(table, FAUX[1])).collect()
    assert [(r.id, r.found, r.name) for r in found] == [(FAUX[1], False, None)]


def test_get_entry(catalog, table):
    row = cat.lookup(catalog(FAUX), ids(table, FAUX[1])).first()
    assert (row.found, row.id, row["name"], row.size, row.status) == (
        True, FAUX[1], FAUX[1] + ".png", 812, "remote",
    )


def test_update_no_entry(catalog):
    out = cat.update_existing(catalog(), catalog(FAUX), AS_OF)
    assert out.catalog.isEmpty() and out.old.isEmpty()
    assert rows_of(out.missing, "id") == [(FAUX[1],)]


def test_update_entry(catalog, table):
    change = table("id string, replications int", (FAUX[1], 0))
    out = cat.update_existing(catalog(FAUX), change, AS_OF)
    assert rows_of(out.old, "id", "replications") == [(FAUX[1], 3)]
    assert rows_of(out.catalog, "id", "size", "replications", "modified") == [(FAUX[1], 812, 0, NOW)]
    assert out.missing.isEmpty()


def test_update_to_null_is_an_update(catalog, table):
    change = table("id string, name string", (FAUX[1], None))
    out = cat.update_existing(catalog(FAUX), change, AS_OF)
    assert rows_of(out.catalog, "name", "modified") == [(None, NOW)]


def test_remove_no_entry(catalog, table):
    out = cat.remove(catalog(), ids(table, FAUX[1]))
    assert out.catalog.isEmpty() and out.removed.isEmpty()
    assert rows_of(out.missing) == [(FAUX[1],)]


def test_remove_entry(catalog, table):
    before = catalog(FAUX)
    out = cat.remove(before, ids(table, FAUX[1], FAUX[1]))
    assert rows_of(out.removed) == rows_of(before)
    assert out.catalog.isEmpty() and out.missing.isEmpty()


def test_upsert_resets_state_unless_preserved(catalog, table):
    before = catalog(("a", "x", 10, "local", 3), ("a", "y", 20, "local", 2))
    rows = table(
        "node_id string, id string, name string, size bigint, status string, replications int, seq int",
        ("a", "x", "first", 0, "remote", 0, 1),
        ("a", "x", "last", 0, "remote", 0, 2),
        ("a", "z", "new", 0, "remote", 0, 1),
    )
    after = cat.upsert(before, rows, AS_OF, seq="seq")
    assert rows_of(after, "id", "name", "size", "status") == [
        ("x", "last", 0, "remote"), ("y", "y.png", 20, "local"), ("z", "new", 0, "remote"),
    ]
    kept = cat.upsert(before, rows, AS_OF, seq="seq", preserve=True)
    assert rows_of(kept, "id", "name", "size", "status", "replications") == [
        ("x", "last", 10, "local", 3), ("y", "y.png", 20, "local", 2), ("z", "new", 0, "remote", 0),
    ]


def test_upsert_by_node_and_id_leaves_other_nodes_alone(catalog):
    before = catalog(("a", "x", 1, "local", 1), ("b", "x", 2, "local", 1))
    after = cat.upsert(before, catalog(("b", "x", 9, "remote", 0)), AS_OF, ("node_id", "id"))
    assert rows_of(after, "node_id", "size") == [("a", 1), ("b", 9)]


def test_status_age_and_null_age(catalog, spark):
    from pyspark.sql import functions as F

    files = catalog(("a", "x", 1, "local", 1), ("a", "y", 1, "remote", 1), ("a", "z", 1, "odd", 1))
    assert rows_of(cat.by_status(files, "remote"), "id") == [("y",)]
    assert rows_of(cat.valid_status(files), "id") == [("x",), ("y",)]
    assert cat.older_than(files, "2024-01-01 00:00:00").isEmpty()
    assert cat.older_than(files, "2024-01-01 00:00:01").count() == 3
    assert cat.older_than(files.withColumn("modified", F.lit(None).cast("timestamp")), AS_OF).isEmpty()


def test_pages_cover_all_rows_once(catalog):
    files = catalog(*[("a", f"{i:03d}", i, "remote", 0) for i in range(47)])
    for shallow in (1000, 0):
        pages = [
            [r.id for r in cat.page(files, 10, n, shallow_rows=shallow).orderBy("id").collect()]
            for n in range(6)
        ]
        assert [len(p) for p in pages] == [10, 10, 10, 10, 7, 0]
        assert [i for p in pages for i in p] == [f"{i:03d}" for i in range(47)]


def test_snapshots(catalog, spark, tmp_path):
    root = str(tmp_path / "catalog")
    assert tables.read_catalog(spark, root).isEmpty()
    assert tables.last_commit(spark, root) is None
    first = catalog(FAUX)
    assert tables.write_catalog(first, root) == 1
    grown = cat.upsert(tables.read_catalog(spark, root), catalog(("a", "x", 1, "local", 1)), AS_OF)
    assert tables.write_catalog(grown, root, batch=7, source="s") == 2
    assert rows_of(tables.read_catalog(spark, root, 1)) == rows_of(first)
    assert tables.read_catalog(spark, root).count() == 2
    assert tables.last_commit(spark, root, "s") == (2, 7)
    assert tables.last_commit(spark, root, "other") == (2, None)
    # A snapshot without its record, as after a crash, is not read, and is written over.
    spark.range(1).write.parquet(f"{root}/v=3")
    assert tables.read_catalog(spark, root).count() == 2
    assert tables.write_catalog(first, root) == 3
    assert tables.read_catalog(spark, root).count() == 1


def test_a_stale_base_changes_nothing(catalog, spark, tmp_path):
    root = str(tmp_path / "catalog")
    first, mine, theirs = (catalog(("a", i, 1, "local", 1)) for i in "xyz")
    assert tables.write_catalog(first, root, base=0) == 1
    assert tables.write_catalog(theirs, root, base=1) == 2
    with pytest.raises(tables.StaleCatalog):
        tables.write_catalog(mine, root, base=1)
    # Both saw version 1, and the other was faster between the look and the record.
    record = {"version": 2, "batch": None, "source": None}
    assert not tables._record(spark, root, record)
    assert rows_of(tables.read_catalog(spark, root), "id") == [("z",)]
    assert tables.last_commit(spark, root).version == 2


def test_null_and_doubled_keys_are_refused(catalog, spark, tmp_path):
    root = str(tmp_path / "catalog")
    tables.write_catalog(catalog(FAUX), root)
    x, y = ("a", "x", 1, "local", 1), ("b", "x", 1, "local", 1)
    for rows, key in (([x, x], ("node_id", "id")), ([x, y], ("id",)), ([(None, *x[1:])], ("id",))):
        with pytest.raises(ValueError, match="one row per"):
            tables.write_catalog(catalog(*rows), root, key=key)
    assert tables.read_catalog(spark, root).count() == 1
    assert tables.write_catalog(catalog(x, y), root) == 2


def test_status_reads_prune_and_push_down(catalog, spark, tmp_path):
    root = str(tmp_path / "catalog")
    tables.write_catalog(catalog(FAUX, ("a", "x", 1, "local", 1)), root)
    stored = tables.read_catalog(spark, root)

    def plan(df):
        spark.conf.set("spark.sql.maxMetadataStringLength", 2000)  # else the filters are cut short
        try:
            return df._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.maxMetadataStringLength")

    assert re.search(r"PartitionFilters: \[[^]]*status#\d+ = local", plan(cat.by_status(stored, "local")))
    assert "LessThan(modified" in plan(cat.older_than(stored, AS_OF))


def test_few_keys_do_not_shuffle_the_catalog(catalog, table, spark, tmp_path):
    root = str(tmp_path / "catalog")
    tables.write_catalog(catalog(FAUX, ("a", "x", 1, "local", 1)), root)
    stored, asked = tables.read_catalog(spark, root), ids(table, "x", "y")
    asked.write.parquet(str(tmp_path / "asked"))
    asked = spark.read.schema("id string").parquet(str(tmp_path / "asked"))
    for df in (
        cat.lookup(stored, asked), cat.remove(stored, asked).catalog, cat.remove(stored, asked).removed,
    ):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def files_of(df):
    return sorted(r[0] for r in df.select(F.input_file_name()).distinct().collect())


def changed(catalog, put=(), gone=()):
    puts = catalog(*put).withColumn("gone", F.lit(False))
    return puts.unionByName(catalog(*gone).withColumn("gone", F.lit(True)))


def test_a_few_changes_touch_a_few_buckets(catalog, spark, tmp_path):
    root = str(tmp_path / "catalog")
    rows = [(f"n{i % 3}", f"{i:04d}", i, "local" if i % 2 else "remote", 1) for i in range(600)]
    tables.write_catalog(catalog(*rows), root, buckets=40)
    before = set((tmp_path / "catalog").rglob("*.parquet"))
    put = [(f"n{i % 3}", f"{i:04d}", -1, "remote", 9) for i in range(0, 6)] + [("n9", "new", 5, "local", 1)]
    gone = [(f"n{i % 3}", f"{i:04d}", 0, "remote", 0) for i in range(100, 103)]
    assert tables.write_changes(changed(catalog, put, gone), root, source="s", files=[11, 12]) == 2
    written = {p.parent.name for p in set((tmp_path / "catalog").rglob("*.parquet")) - before}
    assert 0 < len(written) <= 10
    want = {(r[0], r[1]): r[2:] for r in rows}
    want.update({(r[0], r[1]): r[2:] for r in put})
    for r in gone:
        del want[r[0], r[1]]
    now = tables.read_catalog(spark, root)
    assert rows_of(now, "node_id", "id", "size", "status", "replications") == sorted((*k, *v) for k, v in want.items())
    assert rows_of(tables.read_catalog(spark, root, 1), "id", "size") == sorted((r[1], r[2]) for r in rows)
    assert rows_of(tables.applied_files(spark, root, "s")) == [(11,), (12,)]
    # a read of some buckets opens their files alone
    some = tables.touched_buckets(spark, root, catalog(*put[:2]))
    opened = files_of(tables.read_catalog(spark, root, 1, some))
    assert len(some) <= 2 and all(any(f"bucket={b}/" in f for b in some) for f in opened)


def test_later_changes_win_and_compaction_changes_no_row(catalog, spark, tmp_path):
    root = str(tmp_path / "catalog")
    tables.write_catalog(catalog(*[("a", f"{i}", i, "local", 1) for i in range(50)]), root, buckets=5)
    for turn in range(12):  # versions of two digits are later than those of one
        put = [("a", "7", 1000 + turn, "remote", turn), ("a", f"new{turn}", turn, "local", 1)]
        tables.write_changes(changed(catalog, put, [("a", f"{20 + turn}", 0, "local", 0)]), root)
    tables.write_changes(changed(catalog, gone=[("a", "new3", 0, "local", 0)]), root)
    before = rows_of(tables.read_catalog(spark, root))
    assert ("7", 1011) in [(r[1], r[3]) for r in before] and len(before) == 50 - 12 + 11
    assert not tables.compact(spark, root, least=100)
    done = tables.compact(spark, root, least=6)
    assert done and len(done) < 5
    assert rows_of(tables.read_catalog(spark, root)) == before
    assert tables.compact(spark, root, least=1) and rows_of(tables.read_catalog(spark, root)) == before
    assert rows_of(cat.by_status(tables.read_catalog(spark, root), "remote"), "id") == [("7",)]


def test_changes_are_checked_and_leave_nothing_behind(catalog, spark, tmp_path):
    root = tmp_path / "catalog"
    assert tables.write_changes(changed(catalog, [("a", "x", 1, "local", 1)]), str(root)) == 1  # onto nothing
    x = ("a", "x", 1, "local", 1)
    for rows in ([x, x], [(None, *x[1:])]):
        with pytest.raises(ValueError, match="one row per"):
            tables.write_changes(changed(catalog, rows), str(root))
        with pytest.raises(ValueError, match="one row per"):
            tables.write_catalog(catalog(*rows), str(root))
    with pytest.raises(tables.StaleCatalog):
        tables.write_changes(changed(catalog, [x]), str(root), base=0)
    assert len(list(root.glob("v=*"))) == 1
    assert tables.write_changes(changed(catalog), str(root), batch=3, source="s") == 2  # nothing changed, and that is on record
    assert tables.last_commit(spark, str(root), "s") == (2, 3) and tables.read_catalog(spark, str(root)).count() == 1
