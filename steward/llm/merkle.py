"""A Merkle manifest of a dataset, and for each row the proof that it is in it.

A row is a leaf: the SHA-256 of its fields. Leaves of a group ascend by id; every two
consecutive nodes have their common hash above them, until one is left, the group's subroot; the
subroots, in order of their group, make the top tree in the same way.

Trees are built a block of 2^10 leaves at a time: one task group folds a block ten
levels up and keeps, with each node, its sibling. Proofs are then found by pointer
jumping: a node holds the segment of siblings on its way to an ancestor, and a self-join
with the ancestors doubles the distance and joins the segments end to end, so that a tree of h levels
takes log2(h) joins. Of the inner nodes a round needs those alone whose level is a
multiple of the distance, so that nearly all rows moved are leaves.

A segment is a run of steps, one per level: a byte that says on which side the sibling lies, and
its 32 bytes; or a single zero byte where a node has none.

Defined results. Fields that are null hash as such; a null group is a group of its own and comes first; null ids
come first in a group, and rows of one id are ordered by their leaf, so that repeated
rows are alike and any of them may come first. Empty and very long texts hash like any other. A table of
one row has that leaf as subroot and root, and an empty proof. An empty table gives no rows.
Columns beside the fields are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steward.llm.shared import Batches, mapped, small_by_bytes, written
from steward.operators.running import running

# A block of 2^LEVELS nodes is folded in one group.
LEVELS = 10

ALONE, RIGHT, LEFT = b"\0", b"\1", b"\2"  # where the sibling lies

_NODES = "tree string, level int, idx bigint, digest binary, seg binary"


def field(column: Column) -> Column:
    """How a value goes into its leaf: its length in bytes, a colon and the value; ``-`` if null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def tree_of(group: Column) -> Column:
    """A group as the name of its tree; null is told apart from every value, and sorts first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def parent(*nodes: bytes) -> bytes:
    """The hash above one or two nodes, which go in as hexadecimal text."""
    return sha256(b"".join(n.hex().encode() for n in nodes)).digest()


def fold_block(first: int, digests: list[bytes], whole: bool, levels: int) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """Nodes above some consecutive ones: (levels up, index, digest, step to the sibling).

    The block that is the ``whole`` tree ends at one node; any other goes ``levels`` up, even with one
    node left, as there are others beside it. The last node has no step yet.
    """
    up = 0
    while up < levels and not (whole and len(digests) == 1):
        above = []
        for k in range(0, len(digests), 2):
            pair = digests[k : k + 2]
            yield up, first + k, pair[0], RIGHT + pair[1] if len(pair) == 2 else ALONE
            if len(pair) == 2:
                yield up, first + k + 1, pair[1], LEFT + pair[0]
            above.append(parent(*pair))
        digests, first, up = above, first // 2, up + 1
    yield up, first, digests[0], None


def _fold(nodes: DataFrame, sizes: DataFrame, level: int) -> DataFrame:
    """Blocks of one level folded; ``sizes`` has the number of nodes of each tree there."""
    levels = LEVELS
    block = F.expr(f"idx div {1 << levels}")

    def step(keys: tuple, group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["idx"].to_pylist(), group["digest"].to_pylist(), strict=True))
        tree, whole = keys[0].as_py(), group["n"][0].as_py() <= 1 << levels
        found = list(fold_block(rows[0][0], [r[1] for r in rows], whole, levels))
        columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)]
        columns[0] = pa.array([level + f[0] for f in found], pa.int32())
        return pa.table([pa.array([tree] * len(found)), *columns], ["tree", "level", "idx", "digest", "seg"])

    known = nodes.join(small_by_bytes(sizes), "tree").select("tree", "idx", "digest", "n", block.alias("block"))
    return known.groupBy("tree", "block").applyInArrow(step, _NODES)


class Forest:
    """``nodes`` but the roots, each with the step to its sibling, and ``roots`` with their height."""

    def __init__(self, leaves: DataFrame):
        """``leaves``: tree, idx from 0 without gaps, digest."""
        sizes = written(leaves.groupBy("tree").agg(F.count("*").alias("n")), "sizes")
        parts, roots, level, at = [], [], 0, leaves
        while True:
            most = sizes.agg(F.max("n")).first()[0]
            folded = written(_fold(at, sizes, level), "nodes")
            parts.append(folded.filter(F.col("seg").isNotNull()))
            tops = folded.filter(F.col("seg").isNull())
            done = sizes.filter(F.col("n") <= 1 << LEVELS).select("tree")
            roots.append(tops.join(small_by_bytes(done), "tree").select("tree", "level", "digest"))
            if most is None or most <= 1 << LEVELS:
                break
            sizes = written(
                sizes.filter(F.col("n") > 1 << LEVELS).select("tree", F.ceil(F.col("n") / (1 << LEVELS)).alias("n")), "sizes"
            )
            at = tops.join(small_by_bytes(sizes.select("tree")), "tree", "left_semi").select("tree", "idx", "digest")
            level += LEVELS
        self.nodes = reduce(DataFrame.unionByName, parts)
        self.roots = written(reduce(DataFrame.unionByName, roots).withColumnRenamed("level", "height"), "roots")


def proofs(forest: Forest) -> DataFrame:
    """For every leaf (tree, idx) its ``seg`` to the root: pointer jumping, a self-join a round.

    Before a round ``here`` has the leaves still on their way and ``inner`` the nodes at levels that are
    multiples of ``far``; each holds the steps towards the ancestor ``far`` levels up, or to the root.
    """
    heights = small_by_bytes(forest.roots.select("tree", "height"))
    nodes = forest.nodes.join(heights, "tree").select("tree", "level", "idx", "seg", "height")
    done, far = [], 1
    here, inner = nodes.filter("level = 0").drop("level"), nodes.filter("level > 0")
    highest = forest.roots.agg(F.max("height")).first()[0] or 0
    while far < highest:
        arrived = F.col("height") <= far
        done.append(here.filter(arrived).select("tree", "idx", "seg"))
        above = inner.filter((F.col("level") == far) & ~arrived)
        onward = above.select("tree", F.col("idx").alias("up"), F.col("seg").alias("more"))
        joined = F.concat("seg", "more").alias("seg")
        moved = here.filter(~arrived).withColumn("up", F.shiftright("idx", far)).join(onward, ["tree", "up"])
        higher = inner.select("tree", F.col("level").alias("at"), F.col("idx").alias("up"), F.col("seg").alias("more"))
        kept = (
            inner.filter(F.col("level") % (2 * far) == 0)
            .withColumn("up", F.shiftright("idx", far))
            .withColumn("at", F.col("level") + far)
            .join(higher, ["tree", "at", "up"], "left")
            .select("tree", "level", "idx", F.concat("seg", F.coalesce("more", F.lit(b""))).alias("seg"), "height")
        )
        here = written(moved.select("tree", "idx", joined, "height"), "proofs")
        inner = written(kept, "ancestors")
        far *= 2
    done.append(here.select("tree", "idx", "seg"))
    return reduce(DataFrame.unionByName, done)


def steps_of(segment: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Side and sibling of each level; no sibling where a node is alone."""
    at = 0
    while at < len(segment):
        side = segment[at : at + 1]
        size = 0 if side == ALONE else 32
        yield side, segment[at + 1 : at + 1 + size]
        at += 1 + size


def folded(leaf: bytes, segment: bytes) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for side, sibling in steps_of(segment):
        leaf = parent(leaf) if side == ALONE else parent(leaf, sibling) if side == RIGHT else parent(sibling, leaf)
    return leaf


def manifest(
    rows: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id"
) -> DataFrame:
    """Per row: ``order``, leaf, subroot, root and ``seg``, the siblings up to the root; all binary.

    A row's further columns whose names begin with ``claim`` go along, for ``checked``.
    """
    claims = [c for c in rows.columns if c.startswith("claim")]
    leaves = written(
        rows.select(F.col(order).alias("_order"), tree_of(F.col(group)).alias("tree"), leaf_of(*map(F.col, fields)).alias("digest"), *claims),
        "leaves",
    )
    placed = written(running(leaves, ["tree"], ["_order", "digest"], rank="idx").withColumn("idx", F.col("idx") - 1), "placed")
    low = Forest(placed)
    top_name = F.lit("").alias("tree")
    tops = written(running(low.roots, [], ["tree"], rank="idx"), "tops").withColumn("idx", F.col("idx") - 1)
    high = Forest(tops.select(top_name, "idx", "digest"))
    root = high.roots.select(F.col("digest").alias("root"))
    ends = (
        tops.join(proofs(high).select("idx", F.col("seg").alias("high")), "idx", "left")
        .join(F.broadcast(root))
        .select("tree", F.col("digest").alias("subroot"), "root", "high")
    )
    below = proofs(low).withColumnRenamed("seg", "low")
    whole = F.concat(F.coalesce("low", F.lit(b"")), F.coalesce("high", F.lit(b""))).alias("seg")
    return (
        placed.join(below, ["tree", "idx"], "left")
        .join(small_by_bytes(written(ends, "ends")), "tree")
        .select(F.col("_order").alias(order), F.col("digest").alias("leaf"), "subroot", "root", whole, *claims)
    )


def checked(proved: DataFrame, order: str = "doc_id", claim: str = "claim") -> DataFrame:
    """Digests as text, a digest of the proof, and whether the leaf a row claims leads to the root."""

    def step(batches: Batches) -> Batches:
        for batch in batches:
            segments = batch["seg"].to_pylist()
            ends = [folded(c, s) for c, s in zip(batch["claim"].to_pylist(), segments, strict=True)]
            proof = [sha256(b"".join(n.hex().encode() for _, n in steps_of(s))).hexdigest() for s in segments]
            same = [e == r for e, r in zip(ends, batch["root"].to_pylist(), strict=True)]
            texts = {c: [d.hex() for d in batch[c].to_pylist()] for c in ("leaf", "subroot", "root")}
            yield pa.RecordBatch.from_pydict(
                {"id": batch["id"], **texts, "proof_sha256": proof, "folded_root": [e.hex() for e in ends], "verified": pa.array(same, pa.bool_())}
            )

    asked = proved.select(F.col(order).alias("id"), "leaf", "subroot", "root", "seg", F.col(claim).alias("claim"))
    schema = "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return mapped(asked, step, schema).withColumnRenamed("id", order)
