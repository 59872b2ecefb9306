import random
import shutil

from pyspark.sql import functions as F
from rows import rows_of
from steward.operators.diff import reconcile
from steward.plans import sync
from steward.sources import tables
from steward.sources.digests import LEAVES, bucket_of, combined, differing, leaf_digests, leaf_of

AS_OF = "2024-02-01 00:00:00"
KEY = ("node_id", "id")
LINE = "node_id string, id string, name string, n int"


def kept(spark, root, version=None):
    digests, buckets = tables.catalog_digests(spark, root, version)
    return rows_of(digests), buckets


def lines_of(catalog):
    return catalog.select("node_id", "id", "name", F.lit(1).alias("n"))


def changed(catalog, put=(), gone=()):
    puts = catalog(*put).withColumn("gone", F.lit(False))
    return puts.unionByName(catalog(*gone).withColumn("gone", F.lit(True)))


def test_digests_are_kept_up_by_every_write(catalog, spark, tmp_path):
    """Puts over known and new keys, removals of known and unknown ones, compaction: always those of the rows."""
    root, rng = str(tmp_path / "c"), random.Random(3)
    tables.write_catalog(catalog(*[("a", f"{i}", i, "local", 1) for i in range(60)]), root, buckets=4)
    for turn in range(4):
        some = rng.sample(range(90), 12)
        put = [(rng.choice("ab"), f"{i}", turn, "remote", 0) for i in some[:6]]
        gone = [(rng.choice("ab"), f"{i}", 0, "local", 0) for i in some[6:]]
        rows = changed(catalog, put, gone).withColumn("name", F.concat("name", F.lit(f"-{turn}")))
        tables.write_changes(rows, root)
        if turn == 2:
            assert tables.compact(spark, root, least=2)
        digests, buckets = kept(spark, root)
        assert buckets == 4 and digests == rows_of(leaf_digests(tables.read_catalog(spark, root), 4))
    # Only the state of a row changes: the digest does not.
    before = kept(spark, root)
    tables.write_changes(tables.read_catalog(spark, root).limit(5).withColumns({"size": F.lit(7), "gone": F.lit(False)}), root)
    assert kept(spark, root) == before
    # What is taken out whole leaves none.
    tables.write_changes(tables.read_catalog(spark, root).withColumn("gone", F.lit(True)), root)
    assert kept(spark, root) == ([], 4)


def test_a_catalog_recorded_without_digests_has_them_made(catalog, spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    rows = catalog(("a", "x", 1, "local", 1), ("a", "y", 1, "local", 1))
    assert kept(spark, root) == ([], tables.BUCKETS)
    record = tables._record
    monkeypatch.setattr(tables, "_record", lambda s, r, c: record(s, r, {k: v for k, v in c.items() if k != "digests"}))
    tables.write_catalog(rows, root)
    monkeypatch.undo()
    for _ in range(2):
        assert kept(spark, root)[0] == rows_of(leaf_digests(tables.read_catalog(spark, root), tables.BUCKETS))
        tables.write_changes(changed(catalog, [("a", "z", 1, "local", 1)]), root)


def test_digests_tell_names_nodes_nulls_and_counts_apart(table):
    def of(*rows):
        return leaf_digests(table("node_id string, id string, name string", *rows), 2)

    base = of(("a", "x", "n"))
    for other in (of(("a", "x", "m")), of(("b", "x", "n")), of(("a", "x", None)), of(("a", "x", "n"), ("b", "x", "n")), of()):
        assert differing(base, other).count() == 1
    assert differing(of(("a", "x", None)), of(("a", "x", ""))).count() == 1
    assert differing(base, of(("a", "x", "n"))).isEmpty() and differing(of(), of()).isEmpty()
    gone = leaf_digests(table("node_id string, id string, name string", ("a", "x", "n")), 2, sign=-1)
    assert combined(base.unionByName(gone)).isEmpty()


def test_leaves_spread_within_a_bucket(spark):
    ids = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    counts = ids.groupBy(bucket_of(F.col("id"), 4), leaf_of(F.col("id"))).count()
    assert counts.count() == 4 * LEAVES and counts.agg(F.max("count")).first()[0] < 200


def test_a_manifest_that_agrees_opens_no_data_file(catalog, spark, tmp_path):
    root = tmp_path / "c"
    rows = catalog(*[("a", f"{i}", i, "local", 1) for i in range(40)])
    tables.write_catalog(rows, str(root), buckets=4)
    tables.write_changes(changed(catalog, [("b", "new", 1, "remote", 0)], [("a", "3", 0, "local", 0)]), str(root))
    left = [("a", f"{i}", i, "local", 1) for i in range(40) if i != 3]
    lines = lines_of(catalog(*left, ("b", "new", 1, "remote", 0)))
    for data in root.glob("v=*"):
        shutil.rmtree(data)
    assert sync.reconcile_kept(spark, lines, str(root), AS_OF, ("n",)) is None


def test_only_buckets_that_differ_are_opened(catalog, table, spark, tmp_path):
    root = tmp_path / "c"
    rows = [("a", f"{i}", i, "local", 1) for i in range(200)]
    tables.write_catalog(catalog(*rows), str(root), buckets=16)
    lines = lines_of(catalog(*rows)).filter("id <> '7'").withColumn(
        "name", F.when(F.col("id") == "9", "renamed").otherwise(F.col("name"))
    ).unionByName(table(LINE, ("a", "200", "old", 1), ("a", "200", "new", 2)))
    touched = set(tables.touched_buckets(spark, str(root), table("id string", ("7",), ("9",), ("200",))))
    for data in root.glob("v=*/bucket=*"):
        if int(data.name.split("=")[1]) not in touched:
            shutil.rmtree(data)
    found = sync.reconcile_kept(spark, lines, str(root), AS_OF, ("n",))
    assert rows_of(found, "id", "name", "change") == [
        ("200", "new", "add"), ("7", "7.png", "remove"), ("9", "renamed", "touch"),
    ]


def test_agrees_with_a_full_reconcile_on_random_manifests(catalog, spark, tmp_path):
    rng = random.Random(5)
    for turn in range(3):
        root = str(tmp_path / f"c{turn}")
        rows = [(rng.choice("ab"), f"{i}", i, rng.choice(["local", "remote"]), 1) for i in range(80)]
        before = catalog(*rows)
        tables.write_catalog(before, root, buckets=rng.choice([1, 3, 8]))
        manifest = lines_of(before).filter(~F.col("id").isin([str(i) for i in rng.sample(range(80), turn)])).withColumn(
            "name", F.when(F.col("id").isin([str(i) for i in rng.sample(range(80), 5)]), F.lit(None)).otherwise(F.col("name"))
        )
        whole = reconcile(manifest.drop("n"), before, AS_OF, KEY, renamed_only=True)
        assert rows_of(sync.reconcile_kept(spark, manifest, root, AS_OF, ("n",))) == rows_of(whole)


def test_from_text_to_sweep_by_digests(catalog, table, spark, tmp_path):
    """What differs is recorded with its lists; a second check finds nothing and records nothing."""
    root, path = str(tmp_path / "c"), tmp_path / "m"
    path.mkdir()
    (path / "one.ks").write_text("x kept.png\ny other.png\nz z.png\n")
    tables.write_catalog(
        catalog(("a", "x", 1, "local", 1), ("a", "y", 1, "local", 1), ("a", "w", 1, "local", 1)), root, buckets=4
    )
    seen = sync.Observed(
        table("id string, peer_id string, seen_at timestamp, ok boolean"),
        table("id string, size bigint"),
        table("node_id string, max_bytes bigint", ("a", 100)),
        5,
        AS_OF,
    )
    scope = sync.Scope(
        table("node_id string, cid string", ("a", "w"), ("a", "x")),
        table("parent string, child string"),
        table("node_id string, cid string, pin_type string", ("a", "w", "recursive"), ("a", "x", "recursive")),
    )

    def check():
        return sync.run_verify(spark, str(path), root, seen, scope, lambda lines: lines.withColumn("node_id", F.lit("a")))

    assert check() == 2
    now = tables.read_catalog(spark, root)
    assert rows_of(now, "id", "name") == [("x", "kept.png"), ("y", "other.png"), ("z", "z.png")]
    assert rows_of(tables.read_list(spark, root, "unpin")) == [("a", "w")]
    assert rows_of(tables.read_list(spark, root, "sweep")) == [("a", "w")]
    assert check() == 2
