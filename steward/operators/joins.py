"""Joins of many rows to one row per key, where a few keys may hold most of the rows.

Spark splits a heavy key of a join at runtime, but only where both sides come straight
from a shuffle, which an aggregation by the same key avoids; and it broadcasts a side
only if it can tell that it is small, which it cannot for the result of an outer join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.session import BROADCAST_ROWS, settle


def lookup_join(many: DataFrame, facts: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to a large table of one row per key, of type string.

    The key is rebuilt on the side of the facts, so that their partitioning is not taken
    over and the join shuffles both sides.
    """
    fresh = facts.withColumn(key, F.concat(F.col(key), F.lit("")))
    return many.join(fresh, key, how)


def small_side(facts: DataFrame) -> DataFrame:
    """Settle a table that should be small: broadcast if a count shows it is, else shuffled."""
    facts = settle(facts)
    return F.broadcast(facts) if facts.count() <= BROADCAST_ROWS else facts
