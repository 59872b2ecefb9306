"""Comparing a manifest with a catalog, or with an earlier manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steward.operators.catalog import Key, keep_state, latest, timestamp
from steward.schemas import ADD, CATALOG_COLUMNS, REMOTE, REMOVE

TOUCH = "touch"


def latest_line(
    lines: DataFrame, order: Sequence[str], key: Key = ("id",)
) -> DataFrame:
    """One row per key: the name on its last line, in walk order."""
    slim = lines.select(*key, "name", *order)
    last = latest(slim, key, F.struct(*order))
    return last.select(*key, "name")


def _fresh(manifest: DataFrame, as_of: str | Column) -> DataFrame:
    """Manifest rows as new catalog rows: nothing stored, nothing counted yet."""
    defaults = {
        "node_id": F.col("node_id") if "node_id" in manifest.columns else F.lit(None).cast("string"),
        "size": F.lit(0).cast("bigint"),
        "status": F.lit(REMOTE),
        "modified": timestamp(as_of),
        "replications": F.lit(0),
    }
    return manifest.select(
        *[defaults[c].alias(c) if c in defaults else F.col(c) for c in CATALOG_COLUMNS]
    )


def find_added(
    manifest: DataFrame, catalog: DataFrame, as_of: str | Column, key: Key = ("id",)
) -> DataFrame:
    """Manifest rows the catalog lacks. ``manifest`` holds one row per key."""
    key = list(key)
    new = manifest.join(catalog.select(*key), key, "left_anti")
    return _fresh(new, as_of).withColumn("change", F.lit(ADD))


def find_touched(
    manifest: DataFrame, catalog: DataFrame, as_of: str | Column, key: Key = ("id",)
) -> DataFrame:
    """Rows in both: the name follows the manifest, the state stays."""
    key = list(key)
    names = manifest.select(*key, F.col("name").alias("_name"))
    return (
        catalog.join(names, key)
        .withColumn("name", F.col("_name"))
        .withColumn("modified", timestamp(as_of))
        .select(*CATALOG_COLUMNS, F.lit(TOUCH).alias("change"))
    )


def find_removed(manifest: DataFrame, catalog: DataFrame, key: Key = ("id",)) -> DataFrame:
    """Catalog rows the manifest no longer lists."""
    key = list(key)
    gone = catalog.join(manifest.select(*key), key, "left_anti")
    return gone.select(*CATALOG_COLUMNS, F.lit(REMOVE).alias("change"))


def reconcile(
    manifest: DataFrame, catalog: DataFrame, as_of: str | Column, key: Key = ("id",), renamed_only: bool = False
) -> DataFrame:
    """Added, touched and removed rows from one full outer join.

    Both sides hold one row per key, so no key can be heavier than another. With ``renamed_only`` a row
    that is in both is touched only if its name changes.
    """
    key = list(key)
    node = F.col("node_id") if "node_id" in manifest.columns else F.lit(None).cast("string")
    listed = manifest.select(
        *key, F.col("name").alias("_name"), node.alias("_node"), F.lit(True).alias("_listed")
    )
    known = catalog.withColumn("_known", F.lit(True))
    both = known.join(listed, key, "full_outer")
    if renamed_only:
        both = both.filter(F.col("_known").isNull() | F.col("_listed").isNull() | ~F.col("name").eqNullSafe(F.col("_name")))
    is_new, is_gone = F.col("_known").isNull(), F.col("_listed").isNull()
    values = {
        "name": F.when(is_gone, F.col("name")).otherwise(F.col("_name")),
        "size": F.when(is_new, F.lit(0)).otherwise(F.col("size")),
        "status": F.when(is_new, F.lit(REMOTE)).otherwise(F.col("status")),
        "modified": F.when(is_gone, F.col("modified")).otherwise(timestamp(as_of)),
        "replications": F.when(is_new, F.lit(0)).otherwise(F.col("replications")),
    }
    if "node_id" not in key:
        values["node_id"] = F.when(is_new, F.col("_node")).otherwise(F.col("node_id"))
    change = F.when(is_new, ADD).when(is_gone, REMOVE).otherwise(TOUCH)
    return both.select(
        *[values[c].alias(c) if c in values else F.col(c) for c in CATALOG_COLUMNS],
        change.alias("change"),
    )


def snapshot_diff(
    old: DataFrame, new: DataFrame, order: Sequence[str], key: Key = ("id",)
) -> DataFrame:
    """Ids that came or went between two manifest versions, as sets of ids.

    Both versions go through one aggregation, so repeated lines combine before the
    shuffle. The name is that of the last line.
    """
    columns = [*key, "name", *order]
    sides = old.select(*columns, F.lit(0).alias("_side")).unionByName(
        new.select(*columns, F.lit(1).alias("_side"))
    )
    seen = sides.groupBy(*key).agg(
        F.min("_side").alias("_first"),
        F.max("_side").alias("_last"),
        F.max_by("name", F.struct("_side", *order)).alias("name"),
    )
    change = F.when(F.col("_first") == 1, ADD).otherwise(REMOVE)
    return seen.filter(F.col("_first") == F.col("_last")).select(
        *key, "name", change.alias("change")
    )


def merge_feed(adds: DataFrame, removes: DataFrame) -> DataFrame:
    """Adds and removes as one feed, told apart by ``change``."""
    return adds.unionByName(removes, allowMissingColumns=True)


def change_class(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The feed's adds and its removes; any other tag is neither."""
    return feed.filter(F.col("change") == ADD), feed.filter(F.col("change") == REMOVE)


def feed_rows(
    catalog: DataFrame,
    feed: DataFrame,
    as_of: str | Column,
    key: Key = ("id",),
    preserve: bool = False,
) -> DataFrame:
    """The catalog rows the adds of a feed lead to."""
    adds, _ = change_class(feed)
    rows = _fresh(adds, as_of)
    return keep_state(rows, catalog, key) if preserve else rows


def apply_feed(
    catalog: DataFrame,
    feed: DataFrame,
    as_of: str | Column,
    key: Key = ("id",),
    preserve: bool = False,
) -> DataFrame:
    """The catalog after a net feed: adds written over, removes taken out.

    A key occurs at most once in a net feed, so one anti join clears the way for both.
    """
    key = list(key)
    changed = feed.filter(F.col("change").isin(ADD, REMOVE)).select(*key)
    untouched = catalog.join(changed, key, "left_anti").select(*CATALOG_COLUMNS)
    return untouched.unionByName(feed_rows(catalog, feed, as_of, key, preserve))


def feed_changes(
    catalog: DataFrame,
    feed: DataFrame,
    as_of: str | Column,
    key: Key = ("id",),
    preserve: bool = False,
) -> DataFrame:
    """A net feed as changed rows, with ``gone`` where one goes, for a catalog that keeps deltas.

    ``catalog`` needs to hold the rows of the feed's ids only.
    """
    puts = feed_rows(catalog, feed, as_of, key, preserve).withColumn("gone", F.lit(False))
    adds, removes = change_class(feed)
    if "node_id" in key:
        out = removes.select("node_id", "id")
    else:
        known = catalog.join(feed.select(*key), list(key), "left_semi").select("node_id", "id")
        out = known.join(puts.select("node_id", "id"), ["node_id", "id"], "left_anti")
    return puts.unionByName(out.withColumn("gone", F.lit(True)), allowMissingColumns=True)
