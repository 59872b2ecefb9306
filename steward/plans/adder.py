"""The decision per file: count it, and pull it when it is rare, drawn, known and fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steward.functions import activation_energy, draw
from steward.operators.catalog import Updated, by_status, update_existing
from steward.operators.joins import lookup_join
from steward.operators.placement import (
    GROUP_ROWS,
    fit_placed,
    node_room,
    used_bytes,
    with_room,
)
from steward.operators.replication import known_facts, replications_of
from steward.schemas import LOCAL, REMOTE
from steward.session import settle

FLEET_KEY = ("node_id", "id")


def adder(
    files: DataFrame,
    catalog: DataFrame,
    providers: DataFrame,
    objects: DataFrame,
    nodes: DataFrame,
    threshold: int | Column,
    seed: int,
    run: int,
    mode: str = "greedy",
    group_rows: int = GROUP_ROWS,
    few: bool = False,
) -> DataFrame:
    """One row per file with its ``outcome`` and what the catalog should say of it.

    ``nodes`` has ``max_bytes``; ``catalog`` tells what each node stores already. With
    ``few`` the files are looked up in the observations instead of counting all. The
    files meet one table of facts per id in a single join, are settled once, and only
    those still in question go on to be fitted.
    """
    factor = F.lit(threshold) if isinstance(threshold, int) else threshold
    asked = files.select(
        *FLEET_KEY, "name", F.col("size").alias("_size"), "status", factor.alias("_factor")
    )
    facts = known_facts(providers, objects, files if few else None)
    looked = (
        lookup_join(asked, facts, "id")
        .withColumn("replications", replications_of())
        .withColumn("energy", activation_energy(F.col("replications"), F.col("_factor")))
        .withColumn("draw", draw(seed, run, F.col("node_id"), F.col("id")))
    )
    count = F.col("replications")
    outcome = (
        F.when(count < 0, "lookup_failed")
        .when((count == 0) | (count >= F.col("_factor")), "no_action")
        .when(F.col("draw") <= F.col("energy"), "not_drawn")
        .when(F.col("object_size").isNull(), "size_unknown")
    )
    columns = [*FLEET_KEY, "name", "size", "status", "replications", "energy", "draw", "outcome"]
    rows = (
        looked.withColumn("outcome", outcome)
        .withColumn("size", F.when(outcome.isNull(), F.col("object_size")).otherwise(F.col("_size")))
        .select(*columns, "_size")
    )
    judged = settle(with_room(rows, node_room(nodes, used_bytes(catalog))))
    open_files = judged.filter(F.col("outcome").isNull())
    fitted = fit_placed(open_files, mode, group_rows=group_rows)
    fits = F.col("fits")
    placed = fitted.select(
        *FLEET_KEY,
        "name",
        F.when(fits, F.col("size")).otherwise(F.col("_size")).alias("size"),
        F.when(fits, LOCAL).otherwise(F.col("status")).alias("status"),
        "replications",
        "energy",
        "draw",
        F.when(fits, "pull").otherwise("no_room").alias("outcome"),
    )
    return judged.filter(F.col("outcome").isNotNull()).select(*columns).unionByName(placed)


def apply_outcomes(catalog: DataFrame, outcomes: DataFrame, as_of: str | Column) -> Updated:
    """The catalog after the adder. Failed lookups and files left out change nothing."""
    effective = outcomes.filter(F.col("outcome").isin("no_action", "not_drawn", "pull"))
    rows = effective.select(*FLEET_KEY, "name", "size", "status", "replications")
    return update_existing(catalog, rows, as_of, FLEET_KEY)


def rebalance(
    catalog: DataFrame,
    providers: DataFrame,
    objects: DataFrame,
    nodes: DataFrame,
    threshold: int | Column,
    as_of: str | Column,
    seed: int,
    run: int,
    mode: str = "greedy",
) -> tuple[DataFrame, DataFrame]:
    """All remote files through the adder: the next catalog, and the outcomes."""
    remote = by_status(catalog, REMOTE)
    outcomes = adder(remote, catalog, providers, objects, nodes, threshold, seed, run, mode)
    return apply_outcomes(catalog, outcomes, as_of).catalog, outcomes
