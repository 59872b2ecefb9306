"""Ranks and running totals that never gather a whole group in one task.

A window over a group puts the group in one task. Here the rows are range partitioned
by group and order instead, so a large group is spread over as many slices as its size
asks for; each slice is ranked by itself and then shifted by what the slices before it
hold. A window thus sees at most one slice, or one row per slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steward.session import settle

SLICE = "_slice"


def _owner(column: str) -> Column:
    """A group key that joins: rows without one belong together too."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def sliced(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` cut into ordered slices, numbered in ``_slice``.

    Range bounds come from a sample, so the cut is settled: every later use of it must
    see the same slices.
    """
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owners = {f"_by_{name}": _owner(name) for name in group}
    return settle(
        df.withColumns(owners)
        .repartitionByRange(slices, *owners, *order)
        .withColumn(SLICE, F.spark_partition_id())
    )


def running_over_slices(
    cut: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    rank: str | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add a rank from 1 and inclusive running totals per group, in order.

    The window and the join to the shifts use one partitioning, by group and slice.
    """
    measures = {**({rank: F.lit(1)} if rank else {}), **(totals or {})}
    owners = [f"_by_{name}" for name in group]
    keys = [*owners, SLICE]
    parts = cut.groupBy(*keys).agg(
        *[F.sum(value).alias(f"_sum_{name}") for name, value in measures.items()]
    )
    earlier = (
        Window.partitionBy(*(owners or [F.lit(0)]))
        .orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = parts.select(
        *keys,
        *[
            F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_off_{name}")
            for name in measures
        ],
    )
    inside = (
        Window.partitionBy(*keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return cut.join(shifts, keys).select(
        *cut.columns,
        *[
            (F.sum(value).over(inside) + F.col(f"_off_{name}")).cast("bigint").alias(name)
            for name, value in measures.items()
        ],
    )


def without_slices(df: DataFrame, group: Sequence[str]) -> DataFrame:
    return df.drop(SLICE, *[f"_by_{name}" for name in group])


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    rank: str | None = None,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    cut = sliced(df, group, order)
    return without_slices(running_over_slices(cut, group, order, rank, totals), group)


def row_index(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """A global row number from 1 in a total order."""
    return running(df, [], order, rank=name)
