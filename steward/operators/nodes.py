"""Node limits and usage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.functions import effective_limit, parse_bytes

GIGABYTE = 1e9


def with_limits(nodes: DataFrame) -> DataFrame:
    """Nodes with ``limit_bytes``, as written, and ``max_bytes``, as it takes effect."""
    parsed = nodes.withColumn("limit_bytes", parse_bytes(F.col("limit")))
    return parsed.withColumn(
        "max_bytes", effective_limit(F.col("limit_bytes"), F.col("disk_free"), F.col("initialised"))
    )


def bad_limits(nodes: DataFrame) -> DataFrame:
    """Nodes whose limit cannot be read as a size."""
    return nodes.filter(parse_bytes(F.col("limit")).isNull())


def usage_report(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """Space offered and used per node, in gigabytes; no node offers more than its disk."""
    offered = F.when(
        F.col("disk_total") < F.col("limit_bytes"), F.col("disk_total")
    ).otherwise(F.col("limit_bytes"))
    return (
        nodes.withColumn("limit_bytes", parse_bytes(F.col("limit")))
        .join(used, "node_id", "left")
        .filter(F.col("limit_bytes").isNotNull())
        .select(
            "node_id",
            "email",
            (offered.cast("double") / GIGABYTE).alias("total_space"),
            (F.coalesce("used", F.lit(0)).cast("double") / GIGABYTE).alias("used_space"),
        )
    )
