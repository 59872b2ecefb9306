"""Connected components of a graph too large for one machine.

Links are rewritten in rounds of two steps until every node points at the smallest node it
can reach: first each node hands its larger neighbours on to its smallest one, then its
smaller neighbours. Minima combine before the shuffle and the joins that follow can be split
at runtime, so a node with very many links is no bottleneck. Each round is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.llm.shared import written


def _hand_larger(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _hand_smaller(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) but the roots themselves.

    The root is the smallest node of a component. Links to null or to itself are dropped;
    repeated ones count once.
    """
    larger = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, seen = written(larger.distinct(), "links"), None
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        now = written(_hand_smaller(_hand_larger(now)), "links")
