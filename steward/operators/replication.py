"""How many nodes hold each file, and which files need more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steward.operators.joins import lookup_join, small_side
from steward.operators.running import running

# Kept lookups lie in a folder for so many days, so that years of them are some dozens of folders.
PERIOD_DAYS = 28


def seen_since(providers: DataFrame, since: str | Column) -> DataFrame:
    """The records of lookups at ``since`` or later: who holds a file now."""
    return providers.filter(F.col("seen_at") >= _moment(since))


def provider_counts(providers: DataFrame, since: str | Column | None = None) -> DataFrame:
    """Distinct peers per id that were seen, and whether the last lookup of it failed.

    Records from before ``since`` do not count, and neither do peers of failed lookups.
    Of lookups at the same time a failed one counts as the last. Pairs of id and peer are
    gathered first, so an id with a third of all records is spread over its peers.
    """
    if since is not None:
        providers = seen_since(providers, since)
    lost = ~F.coalesce("ok", F.lit(False))
    pairs = providers.groupBy("id", "peer_id").agg(
        F.max(~lost).alias("_seen"), F.max(F.struct("seen_at", lost.alias("failed"))).alias("_last")
    )
    return _per_id(pairs)


def _per_id(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("id").agg(
        F.count(F.when(F.col("_seen"), F.col("peer_id"))).alias("providers"),
        F.max("_last")["failed"].alias("failed"),
    )


def period_of(moment: Column) -> Column:
    """The number of a moment's period of ``PERIOD_DAYS`` days, whatever the session's zone."""
    return F.floor(F.unix_seconds(moment.cast("timestamp")) / (86400 * PERIOD_DAYS)).cast("int")


def last_seen(providers: DataFrame) -> DataFrame:
    """(id, peer_id, ok_at, last_at, failed, period): what of each period's records later counts rest on.

    One row per period, id and peer: when the peer was last seen, when it was last looked up, and whether that
    failed. Records without a time count at no moment and are left out. Rows of several batches
    need no merging: ``counts_kept`` takes the latest, so a batch may come late or twice.
    """
    lost = ~F.coalesce("ok", F.lit(False))
    periods = providers.filter(F.col("seen_at").isNotNull()).groupBy("id", "peer_id", period_of(F.col("seen_at")).alias("period"))
    latest = periods.agg(
        F.max(F.when(~lost, F.col("seen_at"))).alias("ok_at"), F.max(F.struct("seen_at", lost.alias("failed"))).alias("_last")
    )
    return latest.select("id", "peer_id", "ok_at", F.col("_last.seen_at").alias("last_at"), "_last.failed", "period")


def settled_seen(seen: DataFrame, since: str | Column) -> DataFrame:
    """``seen`` with one row per id and peer, without those no count at ``since`` or later can need.

    The row stands under the period of the last lookup and keeps when the peer was last seen, be that earlier.
    """
    pairs = _kept_since(seen, since).groupBy("id", "peer_id").agg(
        F.max("ok_at").alias("ok_at"), F.max(F.struct("last_at", "failed")).alias("_last")
    )
    last_at = F.col("_last.last_at")
    return pairs.select("id", "peer_id", "ok_at", last_at.alias("last_at"), "_last.failed", period_of(last_at).alias("period"))


def counts_kept(seen: DataFrame, since: str | Column) -> DataFrame:
    """``provider_counts(..., since)`` from kept rows of ``last_seen``; earlier periods are not opened."""
    held = F.coalesce(F.col("ok_at") >= _moment(since), F.lit(False))
    pairs = _kept_since(seen, since).groupBy("id", "peer_id").agg(
        F.max(held).alias("_seen"), F.max(F.struct("last_at", "failed")).alias("_last")
    )
    return _per_id(pairs)


def _moment(since: str | Column) -> Column:
    return F.lit(since).cast("timestamp") if isinstance(since, str) else since


def _kept_since(seen: DataFrame, since: str | Column) -> DataFrame:
    moment = _moment(since)
    return seen.filter((F.col("period") >= period_of(moment)) & (F.col("last_at") >= moment))


def known_facts(
    providers: DataFrame, objects: DataFrame, ids: DataFrame | None = None
) -> DataFrame:
    """One row per id with its provider count and size, for a single join to the files.

    Given the few ``ids`` of interest, all other records are dropped where they are read.
    """
    if ids is not None:
        ids = small_side(ids.select("id").distinct())
        providers = providers.join(ids, "id", "left_semi")
        objects = objects.join(ids, "id", "left_semi")
    sizes = objects.groupBy("id").agg(F.max("size").alias("object_size"))
    return provider_counts(providers).join(sizes, "id", "full_outer")


def replications_of() -> Column:
    """The count to record, from the columns of ``provider_counts``: −1 after a failed lookup."""
    seen = F.coalesce("providers", F.lit(0))
    return F.when(F.coalesce("failed", F.lit(False)), F.lit(-1)).otherwise(seen).cast("int")


def count_providers(
    files: DataFrame, providers: DataFrame, since: str | Column | None = None
) -> DataFrame:
    """The files with fresh ``replications``, counted exactly."""
    return with_counts(files, provider_counts(providers, since))


def with_counts(files: DataFrame, counts: DataFrame) -> DataFrame:
    """The files with ``replications`` from the rows of ``provider_counts`` or ``counts_kept``."""
    counted = lookup_join(files.drop("replications"), counts, "id")
    return counted.withColumn("replications", replications_of()).drop(
        "providers", "failed"
    )


def attach_threshold(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Each file with the replication factor of its manifest.

    One row per manifest; Spark broadcasts it when its size allows and otherwise
    splits a manifest that dominates the files.
    """
    return files.join(manifests.select("manifest", "threshold"), "manifest")


def under_replicated(files: DataFrame, threshold: int | Column) -> DataFrame:
    """Files some node holds, yet too few. A file nobody holds cannot be pulled."""
    held = F.col("replications")
    return files.filter((held >= 1) & (held < threshold))


def rank_by_need(files: DataFrame) -> DataFrame:
    """Rank the files of each node, the least replicated first."""
    return running(files, ["node_id"], ["replications", "id"], rank="need_rank")


def neediest(files: DataFrame, k: int) -> DataFrame:
    """The ``k`` least replicated files of all."""
    return files.orderBy("replications", "id").limit(k)
