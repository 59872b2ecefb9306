"""Corrupt blocks, blocks nothing refers to, and what to unpin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.schemas import LOCAL
from steward.session import BROADCAST_ROWS, laid_out, settle
from steward.sources.tables import read_digests

# The union of settled rounds is settled again after this many, to keep its plan short.
ROUNDS_PER_PLAN = 8

# After so many levels a graph may count as deep: one with this many links for each node of the last level.
LEVEL_ROUNDS, DEEP = 2, 32

# Steps are doubled as long as they are no more than so many times the links.
GROWTH = 4


def _key(*tables: DataFrame) -> list[str]:
    """What names a stored block: the node too, where all tables know it."""
    scoped = all("node_id" in t.columns for t in tables)
    return ["node_id", "cid"] if scoped else ["cid"]


def scan_pins(pins: DataFrame, pin_type: str = "direct") -> DataFrame:
    return pins.filter(F.col("pin_type") == pin_type).select(*_key(pins))


def unpin_plan(removed: DataFrame, catalog: DataFrame, pins: DataFrame | None = None) -> DataFrame:
    """Removed files a node has stored, and so must unpin.

    With ``pins`` only what is pinned is listed; unpinning anything else does nothing.
    """
    key = ["node_id", "id"] if "node_id" in removed.columns else ["id"]
    stored = catalog.filter(F.col("status") == LOCAL)
    plan = stored.join(removed.select(*key), key, "left_semi").select("node_id", "id")
    if pins is None:
        return plan
    same = ["node_id", "id"] if "node_id" in pins.columns else ["id"]
    held = pins.withColumnRenamed("cid", "id").select(*same)
    return plan.join(held, same, "left_semi").select("node_id", "id")


def _children(steps: DataFrame, of: DataFrame, found: int, key: list[str]) -> DataFrame:
    """What one step leads to; a few nodes are sent to the steps, many are shuffled to where those lie."""
    parents = of.withColumnRenamed("cid", "parent")
    if found <= BROADCAST_ROWS:
        parents = F.broadcast(parents)
    how = "inner" if "node_id" in key else "left_semi"
    return steps.join(parents, "parent", how).drop("parent").withColumnRenamed("child", "cid").select(*key)


def reachable(links: DataFrame, roots: DataFrame, count_rounds: list[int] | None = None) -> DataFrame:
    """Every cid on a path from ``roots`` along (parent, child) links, roots included.

    Links are the same everywhere; roots with a ``node_id`` are followed for each node by itself. Links are
    laid out by parent once, so a round moves only what it found last. Rounds follow the graph level by level; when
    a level holds little beside the links still ahead, the graph is deep, and the step is
    doubled from then on: a round with steps of length n reaches whatever lies up to 2n - 1 steps
    off, so a chain takes rounds by the logarithm of its length. Where a graph has so many ways
    that longer steps outgrow its links, the rest is done level by level. ``count_rounds`` gets a number per round.
    """
    key = _key(roots)
    rounds = [] if count_rounds is None else count_rounds
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = laid_out(links.select("parent", "child").distinct(), "parent", parts)
    total = steps.count()
    reached = frontier = settle(roots.select(*key).distinct())
    doubling = True
    while found := frontier.count():
        if doubling and len(rounds) >= LEVEL_ROUNDS and found * DEEP < total:
            ahead, doubled = _doubled(steps, total, reached, frontier, key, rounds)
            reached = settle(reached.unionByName(ahead))
            if doubled is None:
                break
            frontier, doubling = doubled, False
            continue
        frontier = settle(_children(steps, frontier, found, key).distinct().join(reached, key, "left_anti"))
        reached = reached.unionByName(frontier)
        rounds.append(1)
        if len(rounds) % ROUNDS_PER_PLAN == 0:
            reached = settle(reached)
    return reached


def _doubled(
    links: DataFrame, total: int, reached: DataFrame, frontier: DataFrame, key: list[str], rounds: list[int]
) -> tuple[DataFrame, DataFrame | None]:
    """(what lies ahead of the frontier, the frontier that is left where steps outgrew the links).

    Before a round all nodes less than ``far`` steps off are found, and ``steps`` has the pairs ``far`` apart. If
    nothing new lies from there to twice as far, nothing lies beyond.
    """
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if "node_id" not in key:
        known = reached.withColumnRenamed("cid", "child")
        links = laid_out(links.join(known, "child", "left_anti").select("parent", "child"), "parent", parts)
    steps, far = links, 1
    near = frontier
    while True:
        new = settle(_children(steps, near, near.count(), key).distinct().join(near, key, "left_anti"))
        rounds.append(2 * far)
        near = settle(near.unionByName(new))
        ahead = near.join(reached, key, "left_anti")
        if new.isEmpty():
            return ahead, None
        onward = steps.select(F.col("parent").alias("child"), F.col("child").alias("then"))
        longer = steps.join(onward, "child").select("parent", F.col("then").alias("child")).distinct()
        steps, far = laid_out(longer, "parent", parts), 2 * far
        pairs = steps.count()
        if pairs == 0:
            return ahead, None
        if pairs > GROWTH * total:
            return ahead, new


def sweep(blocks: DataFrame, links: DataFrame, pins: DataFrame) -> DataFrame:
    """Blocks no pin keeps. A recursive pin keeps all below it, a direct pin only itself.

    With ``node_id`` in blocks and pins, a pin keeps blocks of its own node only.
    """
    key = _key(blocks, pins)
    below = reachable(links, scan_pins(pins, "recursive").select(*key))
    kept = below.unionByName(pins.select(*key))
    return blocks.join(kept, key, "left_anti")


def verify_blocks(
    stored: DataFrame,
    expected: DataFrame,
    pins: DataFrame | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """Ids of blocks whose content is gone or does not match its digest.

    Contents are hashed where they are read; only ids and digests are joined. ``stored`` may come with digests
    in place of contents, as ``kept_digests`` gives them. With
    ``pins`` and ``links`` only blocks under a pin are looked at, and the id given is
    that of the bad block, not of the pin. Where the tables have a ``node_id``, each node's
    copy is judged by itself.
    """
    key = _key(stored, expected) if pins is None else _key(stored, expected, pins)
    content = F.sha2(F.col("content").cast("binary"), 256) if "content" in stored.columns else F.col("digest")
    actual = stored.select(*key, content.alias("_actual"))
    wanted = expected.select(*key, "digest")
    if pins is not None:
        watched = pins.select(*key)
        if links is not None:
            watched = reachable(links, scan_pins(pins, "recursive").select(*key)).unionByName(watched)
        wanted = wanted.join(watched, key, "left_semi")
    bad = wanted.join(actual, key, "left").filter(
        F.col("_actual").isNull() | ~F.col("digest").eqNullSafe(F.col("_actual"))
    )
    return bad.select(*key).distinct()


def kept_digests(stored: DataFrame, root: str) -> DataFrame:
    """The blocks of ``stored`` with their ``digest``; only contents that the ledger at ``root`` lacks are read.

    ``stored`` has size, modified and content, as the table of a node's blocks or a scan of its files as binary ones
    (``length`` and ``modificationTime`` renamed; such a scan leaves out empty files). The ledger knows a block by node, cid, size and time, so a block that
    was written anew is read again; one that changed without either shows only to a verification without ledger. What is
    unseen spans a range of times and sizes, and that range reaches the scan: files or row groups outside it are not
    opened, and where nothing is unseen no content is. Contents are hashed before the join. A block whose content is
    null has no digest and is read each time; a null size or time is one like others; a block listed twice under one size and time must have one content.
    """
    spark, key = stored.sparkSession, _key(stored)
    known = read_digests(spark, root)
    node = F.col("node_id") if "node_id" in key else F.lit("")
    slim = ["node_id", "cid", "size", "modified"]
    listed = stored.select(node.alias("node_id"), "cid", "size", "modified").distinct()

    def named(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({c: f"_{c}" for c in slim})

    sure = [F.col(c) == F.col(f"_{c}") for c in ("node_id", "cid")]
    same = [*sure, *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("size", "modified")]]
    due = settle(listed.join(named(known).drop("digest"), same, "left_anti"))
    unsure = F.col("size").isNull() | F.col("modified").isNull()
    ends = [f(c) for c in ("modified", "size") for f in (F.min, F.max)]
    since, until, least, most, some_unsure = due.agg(*ends, F.max(unsure)).first()
    if some_unsure is not None:
        within = F.col("modified").between(since, until) & F.col("size").between(least, most)
        if some_unsure:
            within = within | unsure
        digest = F.sha2(F.col("content").cast("binary"), 256).alias("digest")
        read = stored.filter(within).select(node.alias("node_id"), "cid", "size", "modified", digest)
        found = read.join(named(due), same).select(*slim, "digest")
        found.filter(F.col("digest").isNotNull()).distinct().write.mode("append").parquet(root)
    return listed.join(named(read_digests(spark, root)), same, "left").select(*key, "size", "modified", "digest")


def distinct_bad(verdicts: DataFrame) -> DataFrame:
    """Each bad block once, from rows of a pin and its array of bad nodes."""
    return verdicts.select(F.explode("bad_nodes").alias("cid")).distinct()


def repair_plan(bad: DataFrame, providers: DataFrame | None = None) -> DataFrame:
    """Two steps per bad block: unpin it, then pin it again from another node.

    ``repairable`` says whether a provider is known, and is null without ``providers``; of a
    block of one node, the node itself is no provider.
    """
    # The two steps, in order.
    steps = F.array(
        F.struct(F.lit(1).alias("step"), F.lit("unpin").alias("action")),
        F.struct(F.lit(2).alias("step"), F.lit("pin").alias("action")),
    )
    if providers is None:
        marked = bad.withColumn("repairable", F.lit(None).cast("boolean"))
    else:
        # Two peers are enough to know that there is another one.
        held = (
            providers.filter("ok")
            .select(F.col("id").alias("cid"), "peer_id")
            .join(bad.select("cid").distinct(), "cid", "left_semi")
            .groupBy("cid")
            .agg(F.min("peer_id").alias("_one"), F.max("peer_id").alias("_other"))
        )
        own = F.col("node_id") if "node_id" in bad.columns else F.lit(None)
        other = ~F.col("_one").eqNullSafe(own) | ~F.col("_other").eqNullSafe(own)
        marked = bad.join(held, "cid", "left").withColumn(
            "repairable", F.coalesce(F.col("_one").isNotNull() & other, F.lit(False))
        )
    return marked.select(*_key(bad), "repairable", F.inline(steps))
