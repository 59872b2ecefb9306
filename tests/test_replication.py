from pyspark.sql import Window
from pyspark.sql import functions as F

from rows import rows_of
from steward.operators import replication
from steward.operators.running import running, sliced
from steward.sources import tables

PROVIDER = "id string, peer_id string, seen_at timestamp, ok boolean"


def test_counts_are_distinct_exact_and_void_after_a_failure(catalog, table):
    seen = [("many", f"p{i}", None, True) for i in range(30)]
    seen += [("few", "p1", None, True), ("few", "p1", None, True), ("few", "p2", None, True)]
    seen += [("failed", "p1", None, True), ("failed", None, None, False)]
    seen += [("empty", None, None, True)]
    files = catalog(*[("a", i, 1, "remote", 9) for i in ("many", "few", "failed", "none", "empty")])
    got = replication.count_providers(files, table(PROVIDER, *seen))
    want = {"many": 30, "few": 2, "failed": -1, "none": 0, "empty": 0}
    assert dict(rows_of(got, "id", "replications")) == want
    assert rows_of(replication.under_replicated(got, 5), "id") == [("few",)]


def test_the_last_lookup_and_the_time_count(spark):
    rows = [
        ("back", "p1", "2001-01-01", False), ("back", "p1", "2024-01-01", True), ("back", "p2", "2024-01-01", True),
        ("lost", "p1", "2023-01-01", True), ("lost", None, "2024-01-01", False), ("old", "p1", "2002-01-01", True),
    ]
    df = spark.createDataFrame(rows, "id string, peer_id string, at string, ok boolean")
    df = df.withColumn("seen_at", F.col("at").cast("timestamp"))
    got = lambda since: rows_of(replication.provider_counts(df, since), "id", "providers", "failed")
    assert got(None) == [("back", 2, False), ("lost", 1, True), ("old", 1, False)]
    assert got("2023-06-01 00:00:00") == [("back", 2, False), ("lost", 0, True)]


def lookups(spark, n, seed):
    """Random lookups over 288 days; some failed, some without peer or time, a third of one id."""
    draw = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))
    hour = F.lit("2023-06-01 00:00:00").cast("timestamp") + F.make_interval(days=draw("t", 288), hours=draw("h", 24))
    rows = spark.range(n)
    return rows.select(
        F.when(draw("i", 3) == 0, "hot").otherwise(F.concat(F.lit("i"), draw("j", 20))).alias("id"),
        F.when(draw("p", 12) > 0, F.concat(F.lit("p"), draw("q", 9))).alias("peer_id"),
        F.when(draw("n", 40) > 0, hour).alias("seen_at"),
        F.when(draw("n", 31) > 0, draw("o", 5) > 0).alias("ok"),
    )


def test_kept_counts_equal_the_full_count_after_random_batches(spark, tmp_path):
    root, settled = str(tmp_path / "seen"), str(tmp_path / "settled")
    batches = [lookups(spark, n, seed) for n, seed in ((400, 1), (0, 2), (150, 3), (600, 4))]
    batches.append(batches[0])  # one comes again, after later ones
    full = None
    for k, batch in enumerate(batches):
        tables.write_seen(replication.last_seen(batch), root)
        full = batch if full is None else full.unionByName(batch)
        if k < 2:
            continue
        kept = tables.read_seen(spark, root)
        for since in ("1970-01-01 00:00:00", "2023-09-30 05:00:00", "2024-04-01 00:00:00"):
            want = rows_of(replication.provider_counts(full, since), "id", "providers", "failed")
            assert rows_of(replication.counts_kept(kept, since), "id", "providers", "failed") == want
    since = "2023-09-30 05:00:00"
    tables.write_seen(replication.settled_seen(tables.read_seen(spark, root), since), settled)
    small = tables.read_seen(spark, settled)
    assert small.count() == small.select("id", "peer_id").distinct().count()
    for later in (since, "2024-01-03 00:00:00"):
        want = rows_of(replication.provider_counts(full, later), "id", "providers", "failed")
        assert rows_of(replication.counts_kept(small, later), "id", "providers", "failed") == want


def test_old_periods_are_neither_opened_nor_kept(spark, tmp_path):
    root, since = str(tmp_path / "seen"), "2024-01-02 12:00:00"
    tables.write_seen(replication.last_seen(lookups(spark, 2000, 5)), root)
    period = spark.range(1).select(replication.period_of(F.lit(since).cast("timestamp"))).first()[0]
    recent = replication._kept_since(tables.read_seen(spark, root), since)
    opened = {f.split("period=")[1].split("/")[0] for f in recent.inputFiles()}
    assert opened and recent.count() == tables.read_seen(spark, root).filter(F.col("last_at") >= since).count()
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "period#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    want = rows_of(replication.counts_kept(tables.read_seen(spark, root), since), "id", "providers", "failed")
    gone = tables.forget_seen(spark, root, period)
    assert gone and max(gone) < period
    left = tables.read_seen(spark, root)
    assert left.agg(F.min("period")).first()[0] == period
    assert rows_of(replication.counts_kept(left, since), "id", "providers", "failed") == want


def test_counts_reach_the_files(spark, catalog, table, tmp_path):
    at = "timestamp'2024-01-01 00:00:00'"
    rows = table("id string, peer_id string, ok boolean", ("x", "p", True), ("x", "q", True), ("y", "p", False))
    tables.write_seen(replication.last_seen(rows.withColumn("seen_at", F.expr(at))), str(tmp_path))
    counts = replication.counts_kept(tables.read_seen(spark, str(tmp_path)), "2023-01-01 00:00:00")
    files = catalog(*[("a", i, 1, "remote", 9) for i in "xyz"])
    assert rows_of(replication.with_counts(files, counts), "id", "replications") == [("x", 2), ("y", -1), ("z", 0)]


def test_threshold_per_manifest(catalog, table):
    files = catalog(("a", "x", 1, "remote", 3), ("a", "y", 1, "remote", 3))
    files = files.withColumn("manifest", F.when(F.col("id") == "x", "m1").otherwise("m2"))
    manifests = table("manifest string, threshold int", ("m1", 3), ("m2", 4))
    short = replication.under_replicated(
        replication.attach_threshold(files, manifests), F.col("threshold")
    )
    assert rows_of(short, "id") == [("y",)]


def skewed(spark):
    """2000 rows; a node holds a third of them, and some rows have none."""
    node = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None))
    return spark.range(2000).select(
        node.otherwise(F.concat(F.lit("n"), F.col("id") % 7)).alias("node_id"),
        F.sha1(F.col("id").cast("string")).alias("id"),
        (F.col("id") % 4).cast("int").alias("replications"),
    )


def test_rank_equals_a_window_and_spreads_a_hot_node(spark):
    files = skewed(spark)
    w = Window.partitionBy("node_id").orderBy("replications", "id")
    want = files.withColumn("need_rank", F.row_number().over(w).cast("bigint"))
    got = replication.rank_by_need(files)
    key = lambda rows: sorted(map(str, rows.select(*want.columns).collect()))
    assert key(got) == key(want)
    cut = sliced(files, ["node_id"], ["replications", "id"])
    held = cut.filter("node_id = 'hot'").groupBy("_slice").count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 667


def test_running_totals_without_a_group(spark):
    got = running(spark.range(100), [], ["id"], rank="n", totals={"total": F.col("id")})
    assert [tuple(r) for r in got.orderBy("id").collect()] == [
        (i, i + 1, i * (i + 1) // 2) for i in range(100)
    ]


def test_neediest(catalog):
    files = catalog(*[("a", f"{i}", 1, "remote", 9 - i) for i in range(8)])
    assert rows_of(replication.neediest(files, 2), "id") == [("6",), ("7",)]
