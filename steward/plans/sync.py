"""Bringing catalogs in step with a manifest: first import, patches, and the full check."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steward.functions import ID_DECODED
from steward.operators.catalog import Key, latest
from steward.operators.diff import (
    TOUCH,
    apply_feed,
    change_class,
    feed_changes,
    feed_rows,
    latest_line,
    reconcile,
)
from steward.operators.fold import fold_changes
from steward.operators.integrity import sweep, unpin_plan
from steward.operators.joins import small_side
from steward.plans.adder import FLEET_KEY, adder, apply_outcomes
from steward.schemas import ADD, CATALOG_COLUMNS, REMOVE
from steward.session import settle
from steward.sources import tables, text
from steward.sources.digests import differing, leaf_digests


@dataclass(frozen=True)
class Observed:
    """What was seen of the network and the nodes, and the settings of a run.

    ``threshold`` may be a column of the manifest or patch lines handed to a sync, such as
    ``attach_threshold`` adds; a file then has the factor of its last line.
    """

    providers: DataFrame
    objects: DataFrame
    nodes: DataFrame
    threshold: int | Column
    as_of: str | Column
    seed: int = 0
    run: int = 0
    mode: str = "greedy"


class Synced(NamedTuple):
    """The catalog that follows, what the adder decided, and what to unpin.

    ``changes`` are the rows that differ from the catalog before, with ``gone``, where a sync is of changes.
    """

    catalog: DataFrame
    outcomes: DataFrame
    unpin: DataFrame
    changes: DataFrame | None = None


class Scope(NamedTuple):
    """What lies on the nodes: blocks (node_id, cid), links (parent, child) and pins (node_id, cid, pin_type)."""

    blocks: DataFrame
    links: DataFrame
    pins: DataFrame


def _factors(lines: DataFrame, seen: Observed, order: tuple[str, ...], key: Key) -> DataFrame | None:
    """The factor each line's file has, one row per key; nothing where one holds for all."""
    if isinstance(seen.threshold, int):
        return None
    rated = lines.select(*key, seen.threshold.alias("_factor"), *order)
    return latest(rated, key, F.struct(*order)).select(*key, "_factor")


def _place_added(
    before: DataFrame,
    base: DataFrame,
    added: DataFrame,
    removed: DataFrame,
    seen: Observed,
    key: Key,
    factors: DataFrame | None,
    few: bool = False,
) -> Synced:
    """Run the added files through the adder on the catalog that already has them.

    Space counts as used by what was stored before: unpinned files lie on the disk
    until they are swept.
    """
    threshold = seen.threshold
    if factors is not None:
        added, threshold = added.join(factors, list(key)), F.col("_factor")
    outcomes = adder(
        added, before, seen.providers, seen.objects, seen.nodes,
        threshold, seen.seed, seen.run, seen.mode, few=few,
    )
    following = apply_outcomes(base, outcomes, seen.as_of).catalog
    return Synced(following, outcomes, removed)


def sync_full(
    lines: DataFrame, catalog: DataFrame, seen: Observed, order: tuple[str, ...], key: Key = FLEET_KEY
) -> Synced:
    """Index a whole manifest against the catalog and handle what came and went.

    ``lines`` are manifest lines with a ``node_id``, the node that follows the manifest.
    Serves the first import as well as the periodic check of the catalog.
    """
    manifest = latest_line(lines, order, key)
    feed = settle(reconcile(manifest, catalog, seen.as_of, key))
    base = feed.filter(F.col("change") != REMOVE).select(*CATALOG_COLUMNS)
    added = feed.filter(F.col("change") == ADD).select(*CATALOG_COLUMNS)
    removed = feed.filter(F.col("change") == REMOVE)
    factors = _factors(lines, seen, order, key)
    return _place_added(catalog, base, added, unpin_plan(removed, removed), seen, key, factors)


verify_catalog = sync_full


def reconcile_kept(
    spark: SparkSession,
    lines: DataFrame,
    root: str,
    as_of: str | Column,
    order: tuple[str, ...],
    key: Key = FLEET_KEY,
    version: int | None = None,
) -> DataFrame | None:
    """What a manifest adds, renames and removes in the catalog kept at ``root``, or nothing if they agree.

    ``lines`` are manifest lines with a ``node_id``. The manifest is digested by leaf and held against the digests kept
    with the catalog. Only leaves that differ are joined, and only their buckets opened; where
    none does, no data file of the catalog is. Rows that are in both under one name are not touched: their time stays.
    """
    kept, buckets = tables.catalog_digests(spark, root, version)
    listed = leaf_digests(latest_line(lines, order, key), buckets)
    differ = small_side(differing(listed, kept))
    opened = [r[0] for r in differ.select("bucket").distinct().collect()]  # no more than there are buckets
    if not opened:
        return None
    part = tables.rows_of_leaves(tables.read_catalog(spark, root, version, opened), differ, buckets)
    manifest = latest_line(tables.rows_of_leaves(lines, differ, buckets), order, key)
    return reconcile(manifest, part, as_of, key, renamed_only=True)


def sync_changes(
    net: DataFrame,
    catalog: DataFrame,
    seen: Observed,
    key: Key = FLEET_KEY,
    preserve: bool = False,
    factors: DataFrame | None = None,
) -> Synced:
    """Handle a net feed of adds and removes, one row per key.

    ``factors`` has the replication factor ``_factor`` of each added key, where not one holds for
    all. A file added again starts over as remote, of size 0, unless ``preserve`` is set.
    """
    net = settle(net)
    base = apply_feed(catalog, net, seen.as_of, key, preserve)
    added = feed_rows(catalog, net, seen.as_of, key, preserve)
    _, removes = change_class(net)
    done = _place_added(catalog, base, added, unpin_plan(removes, catalog), seen, key, factors, few=True)
    changed = feed_changes(catalog, net, seen.as_of, key, preserve)
    put = apply_outcomes(changed.filter("NOT gone"), done.outcomes, seen.as_of).catalog.withColumn("gone", F.lit(False))
    return done._replace(changes=put.unionByName(changed.filter("gone")))


def sync_incremental(
    changes: DataFrame,
    catalog: DataFrame,
    seen: Observed,
    order: tuple[str, ...],
    key: Key = FLEET_KEY,
    preserve: bool = False,
) -> Synced:
    """Fold an ordered patch to its net changes and handle those."""
    factors = _factors(changes.filter(F.col("op") == ADD), seen, order, key)
    return sync_changes(fold_changes(changes, order, key), catalog, seen, key, preserve, factors)


def sync_snapshots(
    net: DataFrame,
    catalog: DataFrame,
    seen: Observed,
    key: Key = FLEET_KEY,
    factors: DataFrame | None = None,
) -> Synced:
    """Handle the difference of two manifest versions from ``snapshot_diff``."""
    return sync_changes(net, catalog, seen, key, factors=factors)


def sweep_after(
    synced: Synced, blocks: DataFrame, links: DataFrame, pins: DataFrame
) -> DataFrame:
    """Blocks to delete once the planned files are unpinned and the pulled ones pinned.

    Blocks and pins are those of nodes: what one node unpins stays pinned on the others.
    """
    key = ["node_id", "cid"]
    gone = synced.unpin.select("node_id", F.col("id").alias("cid"))
    pulled = synced.outcomes.filter(F.col("outcome") == "pull").select(
        "node_id", F.col("id").alias("cid"), F.lit("recursive").alias("pin_type")
    )
    kept = pins.join(gone, key, "left_anti").select(*key, "pin_type")
    return sweep(blocks, links, kept.unionByName(pulled))



def _lists(synced: Synced, scope: Scope, rejected: DataFrame) -> tuple[Synced, dict[str, DataFrame]]:
    """What goes on record with the catalog; outcomes and catalog are of one evaluation."""
    synced = synced._replace(outcomes=settle(synced.outcomes))
    swept = sweep_after(synced, *scope)
    return synced, {"outcomes": synced.outcomes, "unpin": synced.unpin, "sweep": swept, "rejects": rejected}


def run_full(
    spark: SparkSession,
    manifest: str,
    root: str,
    seen: Observed,
    scope: Scope,
    assign: Callable[[DataFrame], DataFrame],
    key: Key = FLEET_KEY,
    pattern: str = text.MANIFEST_FILES,
    id_pattern: str | None = None,
) -> int:
    """From the text of a manifest to the sweep, as one version of the catalog at ``root``.

    ``assign`` adds the ``node_id`` of the nodes that follow the manifest to its lines. With the catalog are
    recorded the lists ``outcomes``, ``unpin``, ``sweep`` and ``rejects``; a run that fails half way records none
    of them. Gives the version.
    """
    commit = tables.last_commit(spark, root)
    base = commit.version if commit else 0
    lines = text.scan_manifest(spark, manifest, pattern=pattern, id_pattern=id_pattern)
    done = sync_full(assign(lines.good), tables.read_catalog(spark, root, base), seen, text.ORDER, key)
    done, lists = _lists(done, scope, lines.rejected)
    return tables.write_catalog(done.catalog, root, key=key, base=base, lists=lists)


def run_incremental(
    spark: SparkSession,
    patch: str,
    root: str,
    seen: Observed,
    scope: Scope,
    assign: Callable[[DataFrame], DataFrame],
    key: Key = FLEET_KEY,
    pattern: str = "*",
    id_pattern: str = ID_DECODED,
    preserve: bool = False,
) -> int:
    """As ``run_full`` from the text of a patch; only the rows that change are written."""
    commit = tables.last_commit(spark, root)
    base = commit.version if commit else 0
    lines = settle(text.scan_lines(spark, patch, pattern))
    changes = assign(text.parse_patch(lines, id_pattern))
    done = sync_incremental(changes, tables.read_catalog(spark, root, base), seen, text.ORDER, key, preserve)
    done, lists = _lists(done, scope, text.patch_rejects(lines, id_pattern))
    return tables.write_changes(done.changes, root, base=base, lists=lists)


def run_verify(
    spark: SparkSession,
    manifest: str,
    root: str,
    seen: Observed,
    scope: Scope,
    assign: Callable[[DataFrame], DataFrame],
    key: Key = FLEET_KEY,
    pattern: str = text.MANIFEST_FILES,
    id_pattern: str | None = None,
) -> int:
    """The periodic check of the catalog at ``root`` against the text of a manifest, by digests.

    What differs is handled as a sync of changes, and renamed files follow the manifest. The lists are those of
    ``run_full``. A manifest the catalog agrees with records nothing. Gives the version that holds then.
    """
    commit = tables.last_commit(spark, root)
    base = commit.version if commit else 0
    lines = text.scan_manifest(spark, manifest, pattern=pattern, id_pattern=id_pattern)
    assigned = assign(lines.good)
    feed = reconcile_kept(spark, assigned, root, seen.as_of, text.ORDER, key, base)
    if feed is None:
        return base
    feed = settle(feed)
    factors = _factors(assigned, seen, text.ORDER, key)
    net = feed.filter(F.col("change") != TOUCH).select(*key, "name", "change")
    done = sync_changes(net, tables.read_catalog(spark, root, base), seen, key, factors=factors)
    done, lists = _lists(done, scope, lines.rejected)
    renamed = feed.filter(F.col("change") == TOUCH).select(*CATALOG_COLUMNS, F.lit(False).alias("gone"))
    return tables.write_changes(done.changes.unionByName(renamed), root, base=base, lists=lists)
