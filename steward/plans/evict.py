"""Files a node may give up, and swaps that give one up to make room for rarer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.operators.catalog import by_status
from steward.operators.placement import GROUP_ROWS, fit_capacity
from steward.schemas import LOCAL
from steward.session import settle

# Fixed value: a local file held by more than this part of the cluster may be deleted.
FRACTION = 0.1


def evict_candidates(
    catalog: DataFrame, nodes: DataFrame, fraction: float = FRACTION
) -> DataFrame:
    """Local files held by more than ``fraction`` of all nodes."""
    node_count = nodes.select(F.count("*")).scalar()
    return by_status(catalog, LOCAL).filter(
        F.col("replications") > F.lit(fraction) * node_count
    )


def swap_plan(
    evictable: DataFrame,
    wanted: DataFrame,
    rooms: DataFrame,
    mode: str = "greedy",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per node: evict its best replicated file, then pull rarer ones into the room.

    ``wanted`` holds under-replicated remote files with their sizes. A node that could
    pull nothing keeps its file. One file per node is chosen by an aggregation that
    combines before the shuffle, not by ranking all of them.
    """
    best = settle(
        evictable.groupBy("node_id")
        .agg(
            F.min_by(
                F.struct("id", "size", "replications"),
                F.struct(-F.col("replications"), F.col("id")),
            ).alias("_best")
        )
        .select("node_id", "_best.*")
    )
    freed = best.select("node_id", F.col("size").alias("_freed"))
    widened = rooms.join(freed, "node_id").select(
        "node_id", (F.col("room") + F.col("_freed")).alias("room")
    )
    here = wanted.join(best.select("node_id"), "node_id", "left_semi")
    columns = ["node_id", "id", "size", "replications"]
    fitted = fit_capacity(here.select(*columns), widened, mode=mode, group_rows=group_rows)
    pulls = settle(fitted.filter("fits").select(*columns))
    evicts = best.join(pulls.select("node_id"), "node_id", "left_semi")
    return evicts.select(*columns, F.lit("evict").alias("action")).unionByName(
        pulls.select(*columns, F.lit("pull").alias("action"))
    )
