"""Digests of a catalog, so that two sides that should agree are compared without being joined.

A bucket is cut into leaves by further bits of the hash of an id. The digest of a leaf is how many rows it has
and the exclusive or, twice with different seeds, of a hash of each row's node, id and name. So it does not depend
on the order of rows, partial digests combine before a shuffle, and a change turns the digest of
a leaf into the next one by itself: what goes is taken out by the same hash it came in with. State, size and time
of a row take no part, as a manifest knows nothing of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAVES = 64  # of a bucket

PLACE = ["bucket", "leaf"]
_VALUES = ["held", "one", "other"]


def bucket_of(ids: Column, buckets: int) -> Column:
    """Where rows of an id lie; the same on all nodes, so that a change without node finds them."""
    return F.pmod(F.xxhash64(ids), F.lit(buckets)).cast("int")


def leaf_of(ids: Column) -> Column:
    """The leaf of an id in its bucket, by bits the bucket makes no use of."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(ids), 32), F.lit(LEAVES)).cast("int")


def placed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumns({"bucket": bucket_of(F.col("id"), buckets), "leaf": leaf_of(F.col("id"))})


def leaf_digests(rows: DataFrame, buckets: int, sign: int = 1) -> DataFrame:
    """(bucket, leaf, held, one, other) of rows with one row per node and id.

    With ``sign`` -1 the rows are taken out of a digest it is combined with.
    """
    row = [F.col(c) for c in ("node_id", "id", "name")]
    return placed(rows.select(*row), buckets).groupBy(*PLACE).agg(
        F.sum(F.lit(sign)).cast("bigint").alias("held"),
        F.bit_xor(F.xxhash64(*row)).alias("one"),
        F.bit_xor(F.xxhash64(F.lit("other"), *row)).alias("other"),
    )


def combined(digests: DataFrame) -> DataFrame:
    """One digest per leaf from partial ones; a leaf that comes to nothing has none."""
    whole = digests.groupBy(*PLACE).agg(
        F.sum("held").cast("bigint").alias("held"), F.bit_xor("one").alias("one"), F.bit_xor("other").alias("other")
    )
    return whole.filter((F.col("held") != 0) | (F.col("one") != 0) | (F.col("other") != 0))


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """(bucket, leaf) of the leaves on which two sides do not agree."""
    theirs = other.select(*PLACE, F.struct(*_VALUES).alias("_theirs"))
    both = one.select(*PLACE, F.struct(*_VALUES).alias("_ours")).join(theirs, PLACE, "full_outer")
    return both.filter(~F.col("_ours").eqNullSafe(F.col("_theirs"))).select(*PLACE)
