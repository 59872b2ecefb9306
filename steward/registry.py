"""Every operator as a query over the benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steward.fixtures import ANY_ID, AS_OF, RUN, SEED, SINCE, THRESHOLD, Fixtures
from steward.functions import (
    activation_energy,
    draw,
    has_suffix,
    parse_bytes,
    strip_op,
    valid_id,
)
from steward.functions.cid import decoded
from steward.operators import catalog as cat
from steward.operators import diff, fold, integrity, nodes, placement, replication
from steward.plans import adder as adding
from steward.plans import evict, sync
from steward.session import scratch_path, settle
from steward.sources import tables, text
from steward.streaming.changes import stream_changes

Query = Callable[[SparkSession, str], DataFrame]
FLEET = ["node_id", "id"]

QUERIES: dict[str, Query] = {}


def _query(build: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
    """Register a query under its function's name.

    Timestamps leave without a zone, as the tables they come from have none.
    """

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = build(Fixtures(spark, folder))
        zoned = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})

    QUERIES[build.__name__] = run
    return build


# --- inputs shared by several queries -------------------------------------------------


def _limited(fx: Fixtures) -> DataFrame:
    """Nodes whose limit counts as written."""
    return fx.nodes().withColumn("max_bytes", parse_bytes(F.col("limit")))


def _rooms(fx: Fixtures) -> DataFrame:
    return placement.node_room(_limited(fx), placement.used_bytes(fx.catalog()))


def _seen(fx: Fixtures) -> DataFrame:
    return replication.seen_since(fx.providers(), SINCE)


def _counted(fx: Fixtures) -> DataFrame:
    return replication.count_providers(fx.catalog(), fx.providers(), SINCE)


def _wanted(fx: Fixtures) -> DataFrame:
    """Remote under-replicated files of known size."""
    remote = _counted(fx).filter(F.col("status") == "remote")
    sized = placement.attach_sizes(replication.under_replicated(remote, THRESHOLD), fx.objects())
    return sized.filter(F.col("object_size").isNotNull()).select(
        "node_id", "id", "replications", F.col("object_size").alias("size")
    )


def _observed(fx: Fixtures) -> sync.Observed:
    return sync.Observed(
        _seen(fx), fx.objects(), _limited(fx), THRESHOLD, AS_OF, SEED, RUN
    )


def _edits(fx: Fixtures) -> DataFrame:
    """Rows to write: every third part, some twice, and some parts the catalog lacks."""
    key = F.col("p_partkey")
    part = fx.table("part").filter(key % 3 == 0)
    first = part.select(key, F.lit(1).alias("seq"))
    again = part.filter(key % 2 == 0).select(key, F.lit(2).alias("seq"))
    return first.unionByName(again).select(
        fx._node_of("p_partkey").cast("string").alias("node_id"),
        key.cast("string").alias("id"),
        F.concat(F.lit("edit-"), "seq", F.lit("-"), key).alias("name"),
        (key * 1000 + F.col("seq")).alias("size"),
        F.lit("remote").alias("status"),
        (key % 4).cast("int").alias("replications"),
        "seq",
    )


def _asked(fx: Fixtures) -> DataFrame:
    key = F.col("p_partkey")
    return fx.table("part").filter(key % 5 == 0).select(key.cast("string").alias("id"))


def _on_nodes(fx: Fixtures, changes: DataFrame) -> DataFrame:
    node = F.col("id").cast("bigint") % fx.table("supplier").select(F.count("*")).scalar()
    return changes.withColumn("node_id", node.cast("string"))


def _moves(fx: Fixtures) -> DataFrame:
    return _on_nodes(fx, fx.changes())


def _versions(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    lines = fx.snapshot()
    return lines.filter(F.col("line_no") % 10 != 0), lines.filter(F.col("line_no") % 10 != 1)


def _document_lines(fx: Fixtures) -> DataFrame:
    return fx.table("documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "value")
    )


def _patch_line():
    op = (
        F.when(F.col("name").startswith("view"), " ")
        .when(F.col("op") == "add", "+")
        .otherwise("-")
    )
    return F.concat(op, "id", F.lit("  "), "name", F.lit(" more")).alias("value")


def _write_patch(fx: Fixtures) -> str:
    """The event feed as a patch in text parts, with context lines, in feed order."""
    path = scratch_path(fx.spark, "patch")
    ordered = fx.changes().repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.select(_patch_line()).write.text(path)
    return path


def _write_patches(fx: Fixtures) -> str:
    """The event feed as five patches of one file each, one after the other."""
    path = scratch_path(fx.spark, "patches")
    last = fx.changes().select(F.max("seq")).scalar()
    numbered = fx.changes().withColumn("patch", F.floor(F.col("seq") * 5 / (last + 1)).cast("int"))
    ordered = numbered.repartition("patch").sortWithinPartitions("patch", "seq")
    ordered.select("patch", _patch_line()).write.partitionBy("patch").text(path)
    return path


# --- scans, sources, sinks ------------------------------------------------------------


@_query
def scan_manifest(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "manifest")
    lines = fx.snapshot().select("path", F.concat("id", F.lit("\t"), "name", F.lit(" x")).alias("value"))
    lines.write.partitionBy("path").text(path)
    found = text.scan_manifest(fx.spark, path, manifest="docs", pattern="*.txt")
    return found.good.select("manifest", "id", "name")


@_query
def quarantine_lines(fx: Fixtures) -> DataFrame:
    rejected = text.quarantine_lines(_document_lines(fx)).rejected
    return rejected.select("doc_id", "line_no", "reason")


@_query
def manifest_fields(fx: Fixtures) -> DataFrame:
    return text.quarantine_lines(_document_lines(fx)).good


@_query
def scan_patch(fx: Fixtures) -> DataFrame:
    found = text.scan_patch(fx.spark, _write_patch(fx), ANY_ID, "*.txt")
    return found.select("op", "id", "name")


@_query
def patch_rejects(fx: Fixtures) -> DataFrame:
    """Under the usual id rule no key of the feed is a content id."""
    lines = text.scan_lines(fx.spark, _write_patch(fx), "*.txt")
    return text.patch_rejects(lines).select("op", "value", "reason")


@_query
def patch_net(fx: Fixtures) -> DataFrame:
    found = text.scan_patch(fx.spark, _write_patch(fx), ANY_ID, "*.txt")
    return fold.fold_changes(found, text.ORDER)


@_query
def catalog_snapshot(fx: Fixtures) -> DataFrame:
    root = scratch_path(fx.spark, "catalog")
    tables.write_catalog(fx.catalog(), root)
    edits = cat.latest(_edits(fx), ("id",), "seq").withColumn("modified", cat.timestamp(AS_OF))
    even = F.col("id").cast("bigint") % 2 == 0
    for some in (even, ~even):
        tables.write_changes(edits.filter(some).withColumn("gone", F.lit(False)), root)
    tables.compact(fx.spark, root, least=2)
    return tables.read_catalog(fx.spark, root)


@_query
def scan_providers(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "providers")
    fx.providers().write.parquet(path)
    return tables.scan_providers(fx.spark, path)


@_query
def scan_pins(fx: Fixtures) -> DataFrame:
    return integrity.scan_pins(fx.pins())


@_query
def write_reports(fx: Fixtures) -> DataFrame:
    path = scratch_path(fx.spark, "reports")
    used = placement.used_bytes(fx.catalog())
    tables.write_reports(nodes.usage_report(fx.nodes(), used), path)
    report = F.from_json("value", "email string, total_space double, used_space double")
    return fx.spark.read.text(path).select(report.alias("r")).select("r.*")


# --- projections, filters -------------------------------------------------------------


@_query
def valid_ids(fx: Fixtures) -> DataFrame:
    digest = F.sha2("text", 256)
    base32 = F.concat(F.lit("b"), F.translate(digest, "0189", "ghij"))
    base58 = F.concat(F.lit("Qm"), F.translate(F.substring(digest, 1, 44), "0", "G"))
    kind = F.col("doc_id") % 4
    id_ = F.when(kind == 0, digest).when(kind == 1, base32).when(kind == 2, base58)
    ids = fx.table("documents").select("doc_id", id_.otherwise(F.substring(base58, 1, 20)).alias("id"))
    return ids.withColumn("valid", valid_id(F.col("id")))


@_query
def decoded_ids(fx: Fixtures) -> DataFrame:
    """The documents' digests as ids in several bases, some of them cut short, and decoded again."""
    digest = F.sha2("text", 256)
    raw = F.concat(F.lit("01551220"), digest)
    b64 = F.rtrim(F.base64(F.unhex(raw)), F.lit("="))
    kind = F.col("doc_id") % 6
    id_ = (
        F.when(kind == 0, F.concat(F.lit("f"), raw))
        .when(kind == 1, F.concat(F.lit("F"), F.upper(raw)))
        .when(kind == 2, F.concat(F.lit("m"), b64))
        .when(kind == 3, F.concat(F.lit("u"), F.translate(b64, "+/", "-_")))
        .when(kind == 4, F.concat(F.lit("f"), F.substring(raw, 1, 70)))
        .otherwise(F.concat(F.lit("f"), raw, F.lit("00")))
    )
    ids = fx.table("documents").select("doc_id", id_.alias("id"))
    return ids.withColumn("d", decoded(F.col("id"))).select("doc_id", "id", "d.version", "d.codec", "d.hash", "d.digest")


@_query
def catalog_lookup(fx: Fixtures) -> DataFrame:
    return cat.lookup(fx.catalog(), _asked(fx))


@_query
def by_status(fx: Fixtures) -> DataFrame:
    return cat.by_status(fx.catalog(), "local")


@_query
def older_than(fx: Fixtures) -> DataFrame:
    return cat.older_than(fx.catalog(), "2024-01-11 00:00:00")


@_query
def under_replicated(fx: Fixtures) -> DataFrame:
    return replication.under_replicated(_counted(fx), THRESHOLD).select(*FLEET, "replications")


@_query
def change_class(fx: Fixtures) -> DataFrame:
    adds, removes = diff.change_class(fold.fold_changes(fx.changes()))
    stored = adds.select("id", F.lit("remote").alias("becomes"))
    return stored.unionByName(removes.select("id", F.lit("gone").alias("becomes")))


# --- joins ----------------------------------------------------------------------------


@_query
def find_added(fx: Fixtures) -> DataFrame:
    return diff.find_added(fx.manifest(), fx.catalog(), AS_OF)


@_query
def find_touched(fx: Fixtures) -> DataFrame:
    return diff.find_touched(fx.manifest(), fx.catalog(), AS_OF)


@_query
def find_removed(fx: Fixtures) -> DataFrame:
    return diff.find_removed(fx.manifest(), fx.catalog())


@_query
def reconcile(fx: Fixtures) -> DataFrame:
    return diff.reconcile(fx.manifest(), fx.catalog(), AS_OF, FLEET)


@_query
def reconcile_kept(fx: Fixtures) -> DataFrame:
    """By digests, against a catalog that was written in turns, some of them wrong at first."""
    root = scratch_path(fx.spark, "kept")
    key = F.col("id").cast("bigint")
    tables.write_catalog(fx.catalog().filter(key % 3 != 0), root)
    wrong = fx.catalog().filter(key % 4 == 0).withColumn("name", F.lit("wrong"))
    tables.write_changes(wrong.withColumn("gone", key % 3 == 2), root)
    right = fx.catalog().filter((key % 3 == 0) | (key % 4 == 0))
    tables.write_changes(right.withColumn("gone", F.lit(False)), root)
    lines = fx.manifest().withColumn("line_no", F.col("id").cast("bigint"))
    found = sync.reconcile_kept(fx.spark, lines, root, AS_OF, ("line_no",))
    none = fx.catalog().filter("false").withColumn("change", F.lit(""))
    return none if found is None else found


@_query
def snapshot_diff(fx: Fixtures) -> DataFrame:
    return diff.snapshot_diff(*_versions(fx), order=("path", "line_no"))


@_query
def unpin_plan(fx: Fixtures) -> DataFrame:
    removed = diff.find_removed(fx.manifest(), fx.catalog())
    return integrity.unpin_plan(removed, fx.catalog())


@_query
def unpin_pinned(fx: Fixtures) -> DataFrame:
    removed = diff.find_removed(fx.manifest(), fx.catalog())
    return integrity.unpin_plan(removed, fx.catalog(), fx.pins())


@_query
def attach_sizes(fx: Fixtures) -> DataFrame:
    sized = placement.attach_sizes(fx.catalog().drop("size"), fx.objects())
    known = F.when(F.col("object_size").isNull(), "size_unknown").otherwise("known")
    return sized.select(*FLEET, "object_size", known.alias("size_state"))


@_query
def attach_threshold(fx: Fixtures) -> DataFrame:
    files = _counted(fx).join(fx.manifest_of(), "id")
    short = replication.under_replicated(
        replication.attach_threshold(files, fx.manifests()), F.col("threshold")
    )
    return short.select(*FLEET, "manifest", "threshold", "replications")


# --- aggregations ---------------------------------------------------------------------


@_query
def provider_counts(fx: Fixtures) -> DataFrame:
    return replication.provider_counts(fx.providers(), SINCE)


def _kept(fx: Fixtures) -> DataFrame:
    """Lookups kept in three batches that overlap, as they would arrive over time."""
    root = scratch_path(fx.spark, "seen")
    seen = fx.providers()
    kind = F.pmod(F.xxhash64("id", "peer_id", "seen_at"), F.lit(3))
    for batch in (0, 1, 2):
        part = seen.filter((kind == batch) | (kind == (batch + 1) % 3))
        tables.write_seen(replication.last_seen(part), root)
    return tables.read_seen(fx.spark, root)


@_query
def provider_counts_kept(fx: Fixtures) -> DataFrame:
    return replication.counts_kept(_kept(fx), SINCE)


@_query
def count_providers_kept(fx: Fixtures) -> DataFrame:
    """Counts from kept lookups, after they were settled into one row per id and peer."""
    root = scratch_path(fx.spark, "settled")
    tables.write_seen(replication.settled_seen(_kept(fx), SINCE), root)
    counts = replication.counts_kept(tables.read_seen(fx.spark, root), SINCE)
    return replication.with_counts(fx.catalog(), counts).select("node_id", "id", "replications")


@_query
def count_providers(fx: Fixtures) -> DataFrame:
    return _counted(fx).select(*FLEET, "replications")


@_query
def fold_changes(fx: Fixtures) -> DataFrame:
    return fold.fold_changes(fx.changes(), keep_none=True)


@_query
def fold_changes_chunked(fx: Fixtures) -> DataFrame:
    return fold.fold_changes(fx.changes(), chunk=16)


@_query
def used_bytes(fx: Fixtures) -> DataFrame:
    return placement.used_bytes(fx.catalog())


@_query
def usage_report(fx: Fixtures) -> DataFrame:
    return nodes.usage_report(fx.nodes(), placement.used_bytes(fx.catalog()))


# --- order, rank, capacity ------------------------------------------------------------


@_query
def page(fx: Fixtures) -> DataFrame:
    return cat.page(cat.by_status(fx.catalog(), "remote"), 100, 3)


@_query
def page_deep(fx: Fixtures) -> DataFrame:
    orders = fx.table("orders").select("o_orderdate", "o_orderkey", "o_orderstatus")
    return cat.page(orders, 1000, 9, ["o_orderdate", "o_orderkey"], shallow_rows=0)


@_query
def latest_line(fx: Fixtures) -> DataFrame:
    return diff.latest_line(fx.snapshot(), ["path", "line_no"])


@_query
def under_replicated_ranked(fx: Fixtures) -> DataFrame:
    short = replication.under_replicated(_counted(fx), THRESHOLD)
    return replication.rank_by_need(short.select(*FLEET, "name", "status", "replications"))


@_query
def neediest(fx: Fixtures) -> DataFrame:
    short = replication.under_replicated(_counted(fx), THRESHOLD)
    return replication.neediest(short.select(*FLEET, "replications"), 50)


@_query
def fit_capacity(fx: Fixtures) -> DataFrame:
    return placement.fit_capacity(_wanted(fx), _rooms(fx))


@_query
def fit_capacity_rounds(fx: Fixtures) -> DataFrame:
    return placement.fit_capacity(_wanted(fx), _rooms(fx), group_rows=4)


@_query
def fit_capacity_prefix(fx: Fixtures) -> DataFrame:
    return placement.fit_capacity(_wanted(fx), _rooms(fx), mode="prefix")


# --- set operations -------------------------------------------------------------------


@_query
def merge_feed(fx: Fixtures) -> DataFrame:
    adds = diff.find_added(fx.manifest(), fx.catalog(), AS_OF)
    removes = diff.find_removed(fx.manifest(), fx.catalog())
    return diff.merge_feed(adds, removes).select("id", "name", "change")


@_query
def distinct_bad(fx: Fixtures) -> DataFrame:
    blocks = fx.blocks().filter(F.sha2("content", 256) != F.col("digest"))
    bad = F.array("cid").alias("bad_nodes")
    by_source = blocks.select(F.col("source").alias("pin"), bad)
    return integrity.distinct_bad(by_source.unionByName(blocks.select(F.col("lang").alias("pin"), bad)))


# --- catalog mutations ----------------------------------------------------------------


@_query
def upsert(fx: Fixtures) -> DataFrame:
    return cat.upsert(fx.catalog(), _edits(fx), AS_OF, ("id",), "seq")


@_query
def upsert_preserving(fx: Fixtures) -> DataFrame:
    return cat.upsert(fx.catalog(), _edits(fx), AS_OF, ("id",), "seq", preserve=True)


def _update(fx: Fixtures) -> cat.Updated:
    rows = cat.latest(_edits(fx), ("id",), "seq").select("id", "name", "replications")
    return cat.update_existing(fx.catalog(), rows, AS_OF)


@_query
def update_existing(fx: Fixtures) -> DataFrame:
    return _update(fx).catalog


@_query
def update_old(fx: Fixtures) -> DataFrame:
    return _update(fx).old


@_query
def update_missing(fx: Fixtures) -> DataFrame:
    return _update(fx).missing.select("id")


@_query
def remove(fx: Fixtures) -> DataFrame:
    return cat.remove(fx.catalog(), _asked(fx)).catalog


@_query
def remove_returned(fx: Fixtures) -> DataFrame:
    return cat.remove(fx.catalog(), _asked(fx)).removed


@_query
def remove_missing(fx: Fixtures) -> DataFrame:
    return cat.remove(fx.catalog(), _asked(fx)).missing


# --- scalar expressions ---------------------------------------------------------------


@_query
def energy_draw(fx: Fixtures) -> DataFrame:
    energy = activation_energy(F.col("replications"), F.lit(THRESHOLD))
    chance = draw(SEED, RUN, F.col("node_id"), F.col("id"))
    return fx.catalog().select(
        *FLEET,
        energy.cast("double").alias("energy"),
        chance.alias("draw"),
        (chance > energy).alias("kept"),
    )


@_query
def parse_sizes(fx: Fixtures) -> DataFrame:
    forms = ["GB", " GiB", " kb", ",024 MB", "TB", "x", "", ".37 mib"]
    key = F.col("s_suppkey")
    form = F.element_at(F.array(*[F.lit(f) for f in forms]), (key % 8 + 1).cast("int"))
    sizes = fx.table("supplier").select("s_suppkey", F.concat(key, form).alias("text"))
    return sizes.withColumn("bytes", parse_bytes(F.col("text")))


@_query
def effective_limit(fx: Fixtures) -> DataFrame:
    return nodes.with_limits(fx.nodes()).select("node_id", "limit_bytes", "max_bytes")


@_query
def line_ops(fx: Fixtures) -> DataFrame:
    mark = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit("+-"), F.lit("")), (F.col("doc_id") % 4 + 1).cast("int"))
    raw = F.concat(mark, "id")
    lines = fx.snapshot().withColumn("doc_id", F.col("line_no"))
    return lines.select(
        "line_no", strip_op(raw).alias("id"), has_suffix(F.col("path"), "1.ks").alias("in_scope")
    )


# --- whole jobs -----------------------------------------------------------------------


@_query
def adder_outcomes(fx: Fixtures) -> DataFrame:
    remote = cat.by_status(fx.catalog(), "remote")
    outcomes = adding.adder(
        remote, fx.catalog(), _seen(fx), fx.objects(), _limited(fx), THRESHOLD, SEED, RUN
    )
    return outcomes.select(*FLEET, "size", "status", "replications", "outcome")


@_query
def adder_by_manifest(fx: Fixtures) -> DataFrame:
    """As ``adder_outcomes``, with the factor of each file's manifest."""
    remote = cat.by_status(fx.catalog(), "remote").join(fx.manifest_of(), "id")
    outcomes = adding.adder(
        replication.attach_threshold(remote, fx.manifests()), fx.catalog(), _seen(fx), fx.objects(),
        _limited(fx), F.col("threshold"), SEED, RUN,
    )
    return outcomes.select(*FLEET, "size", "status", "replications", "outcome")


@_query
def rebalance(fx: Fixtures) -> DataFrame:
    following, _ = adding.rebalance(
        fx.catalog(), _seen(fx), fx.objects(), _limited(fx), THRESHOLD, AS_OF, SEED, RUN
    )
    return following


def _full(fx: Fixtures) -> sync.Synced:
    lines = fx.manifest().withColumn("line_no", F.col("id").cast("bigint"))
    return sync.sync_full(lines, fx.catalog(), _observed(fx), ("line_no",))


@_query
def sync_full(fx: Fixtures) -> DataFrame:
    lines = fx.manifest().withColumn("line_no", F.col("id").cast("bigint"))
    empty = fx.catalog().filter("false")
    return sync.sync_full(lines, empty, _observed(fx), ("line_no",)).catalog


@_query
def verify_catalog(fx: Fixtures) -> DataFrame:
    return _full(fx).catalog


@_query
def verify_unpin(fx: Fixtures) -> DataFrame:
    return _full(fx).unpin


@_query
def verify_sweep(fx: Fixtures) -> DataFrame:
    """Every part and a block below it lie on its own node and on the next one."""
    own = cat.by_status(fx.catalog(), "local").select("node_id", F.col("id").alias("cid"))
    pins = own.unionByName(fx.copied_pins()).withColumn("pin_type", F.lit("recursive"))
    return sync.sweep_after(_full(fx), fx.copied_blocks(), fx.part_links(), pins)


@_query
def sync_incremental(fx: Fixtures) -> DataFrame:
    return sync.sync_incremental(_moves(fx), fx.catalog(), _observed(fx), ("seq",)).catalog


@_query
def sync_unpin(fx: Fixtures) -> DataFrame:
    return sync.sync_incremental(_moves(fx), fx.catalog(), _observed(fx), ("seq",)).unpin


@_query
def sync_snapshots(fx: Fixtures) -> DataFrame:
    """Two manifest versions, each lacking a tenth of the parts."""
    key = F.col("p_partkey")
    lines = fx.table("part").select(
        fx._node_of("p_partkey").cast("string").alias("node_id"),
        key.cast("string").alias("id"),
        F.col("p_name").alias("name"),
        key.alias("line_no"),
    )
    old, new = (lines.filter(F.col("line_no") % 10 != missing) for missing in (2, 3))
    net = diff.snapshot_diff(old, new, ["line_no"], FLEET)
    return sync.sync_snapshots(net, fx.catalog(), _observed(fx)).catalog


@_query
def evict_candidates(fx: Fixtures) -> DataFrame:
    held = evict.evict_candidates(_counted(fx), fx.nodes(), 0.05)
    return held.select(*FLEET, "size", "replications")


@_query
def swap_plan(fx: Fixtures) -> DataFrame:
    evictable = evict.evict_candidates(_counted(fx), fx.nodes(), 0.05)
    return evict.swap_plan(evictable, _wanted(fx), _rooms(fx))


# --- integrity ------------------------------------------------------------------------


@_query
def verify_blocks(fx: Fixtures) -> DataFrame:
    return integrity.verify_blocks(fx.blocks(), fx.blocks())


@_query
def verify_twice(fx: Fixtures) -> DataFrame:
    """With a ledger of digests: some blocks are seen empty first, then whole, and the rest for the first time."""
    number = F.substring_index("cid", "-", -1).cast("bigint")
    early = F.col("cid").isNotNull() & (number % 3 == 0)
    blocks = fx.blocks().withColumn("size", F.octet_length("content").cast("bigint"))
    first = blocks.filter(early).withColumn("content", F.lit("")).withColumn("modified", cat.timestamp("2024-01-01"))
    day = F.when(early, cat.timestamp("2024-01-03")).otherwise(cat.timestamp("2024-01-02"))
    root = scratch_path(fx.spark, "digests")
    integrity.kept_digests(first, root)
    return integrity.verify_blocks(integrity.kept_digests(blocks.withColumn("modified", day), root), blocks)


@_query
def verify_pinned(fx: Fixtures) -> DataFrame:
    return integrity.verify_blocks(fx.blocks(), fx.blocks(), fx.shelf_pins(), fx.shelf_links())


@_query
def sweep(fx: Fixtures) -> DataFrame:
    links = settle(fx.links())
    blocks = links.select(F.col("child").alias("cid"))
    return integrity.sweep(blocks, links, fx.pins())


@_query
def sweep_tree(fx: Fixtures) -> DataFrame:
    links = settle(fx.tree_links())
    blocks = links.select(F.col("child").alias("cid")).distinct()
    return integrity.sweep(blocks, links, fx.tree_pins())


@_query
def repair_plan(fx: Fixtures) -> DataFrame:
    bad = integrity.verify_blocks(fx.blocks(), fx.blocks())
    held = fx.providers().withColumn("id", F.concat(F.lit("doc-"), "id"))
    return integrity.repair_plan(bad, held)


@_query
def sweep_nodes(fx: Fixtures) -> DataFrame:
    """Every line on two nodes, each of which pins some of the orders."""
    links = settle(fx.links())
    return integrity.sweep(fx.on_two_nodes(links.select(F.col("child").alias("cid"))), links, fx.node_pins())


@_query
def repair_nodes(fx: Fixtures) -> DataFrame:
    """Each node's bad copies of the documents, and whether another node holds them."""
    stored = fx.on_two_nodes(fx.blocks().select("cid", "content"))
    number = F.substring_index("cid", "-", -1).cast("bigint")
    lost = ((F.col("node_id") == "n0") & (number % 70 == 0)) | ((F.col("node_id") == "n1") & (number % 50 == 0))
    found = stored.withColumn("content", F.when(lost, "").otherwise(F.col("content")))
    expected = stored.select("node_id", "cid", F.sha2("content", 256).alias("digest"))
    bad = integrity.verify_blocks(found, expected)
    ids = stored.filter(((F.col("node_id") == "n0") & (number % 20 == 0)) | ((F.col("node_id") == "n1") & (number % 3 == 0)))
    held = ids.select(F.col("cid").alias("id"), F.col("node_id").alias("peer_id"), F.lit(True).alias("ok"))
    return integrity.repair_plan(bad, held)


# --- stream ---------------------------------------------------------------------------


@_query
def stream_sync(fx: Fixtures) -> DataFrame:
    """Five numbered patches as a stream into a stored catalog, each in its turn."""
    patches = _write_patches(fx)
    root = scratch_path(fx.spark, "streamed")
    tables.write_catalog(fx.catalog(), root)
    query = stream_changes(
        fx.spark,
        patches,
        scratch_path(fx.spark, "progress"),
        root,
        as_of=lambda batch: AS_OF,
        id_pattern=ANY_ID,
        pattern="*.txt",
        assign=lambda changes: _on_nodes(fx, changes),
        files_per_batch=2,
        number=r"patch=(\d+)/",
    )
    query.awaitTermination()
    return tables.read_catalog(fx.spark, root)


# --- from text to sweep ---------------------------------------------------------------


def _effective(fx: Fixtures) -> sync.Observed:
    """As ``_observed``, with each node's limit as it takes effect."""
    return sync.Observed(_seen(fx), fx.objects(), nodes.with_limits(fx.nodes()), THRESHOLD, AS_OF, SEED, RUN)


def _scope(fx: Fixtures) -> sync.Scope:
    """Every part and a block below it lie on its own node and on the next one."""
    own = cat.by_status(fx.catalog(), "local").select("node_id", F.col("id").alias("cid"))
    pins = own.unionByName(fx.copied_pins()).withColumn("pin_type", F.lit("recursive"))
    return sync.Scope(fx.copied_blocks(), fx.part_links(), pins)


@_query
def sync_sweep(fx: Fixtures) -> DataFrame:
    """What is to be deleted after a sync from the text of the manifest, as recorded with it."""
    path, root = scratch_path(fx.spark, "manifest"), scratch_path(fx.spark, "synced")
    fx.manifest().select(F.concat("id", F.lit(" "), "name").alias("value")).write.text(path)
    tables.write_catalog(fx.catalog(), root)
    sync.run_full(fx.spark, path, root, _effective(fx), _scope(fx), lambda lines: _on_nodes(fx, lines), pattern="*.txt")
    return tables.read_list(fx.spark, root, "sweep")


def _patched(fx: Fixtures) -> str:
    root = scratch_path(fx.spark, "patched")
    tables.write_catalog(fx.catalog(), root)
    sync.run_incremental(
        fx.spark, _write_patch(fx), root, _effective(fx), _scope(fx), lambda lines: _on_nodes(fx, lines), pattern="*.txt",
        id_pattern=ANY_ID,
    )
    return root


@_query
def patch_sweep(fx: Fixtures) -> DataFrame:
    """What is to be deleted after a sync from the text of a patch."""
    return tables.read_list(fx.spark, _patched(fx), "sweep")


@_query
def patch_catalog(fx: Fixtures) -> DataFrame:
    """The catalog that sync leaves: the one before, and a delta."""
    return tables.read_catalog(fx.spark, _patched(fx))


@_query
def verify_kept(fx: Fixtures) -> DataFrame:
    """The catalog after a check by digests against the text of the manifest."""
    path, root = scratch_path(fx.spark, "manifest"), scratch_path(fx.spark, "verified")
    one_word = F.translate("name", " ", "_")
    fx.manifest().select(F.concat("id", F.lit(" "), one_word).alias("value")).write.text(path)
    tables.write_catalog(fx.catalog().withColumn("name", one_word), root)
    sync.run_verify(fx.spark, path, root, _effective(fx), _scope(fx), lambda lines: _on_nodes(fx, lines), pattern="*.txt")
    return tables.read_catalog(fx.spark, root)
