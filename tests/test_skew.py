"""Heavy keys: joins are split, and no window or group takes in a whole heavy key."""

import pytest
from pyspark.sql import functions as F

from steward.operators import placement, replication
from steward.operators.joins import lookup_join

# So that a few thousand rows are as good as a few terabytes.
TINY = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.shuffle.partitions": "12",
}


@pytest.fixture()
def tiny(spark):
    before = {k: spark.conf.get(k, None) for k in TINY}
    for k, v in TINY.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files_with_a_hot_id(spark):
    return spark.range(0, 6000, 1, 6).select(
        F.concat(F.lit("n"), F.col("id")).alias("node_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("f"), F.col("id") % 900)).alias("id"),
        F.lit(0).alias("replications"),
    )


def split_at_runtime(df):
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def providers(spark):
    return spark.range(0, 3000, 1, 4).select(
        F.concat(F.lit("f"), F.col("id") % 900).alias("id"),
        F.col("id").cast("string").alias("peer_id"),
        F.lit(None).cast("timestamp").alias("seen_at"),
        F.lit(True).alias("ok"),
    )


def test_counting_splits_a_hot_id(tiny):
    assert split_at_runtime(replication.count_providers(files_with_a_hot_id(tiny), providers(tiny)))


def test_sizing_splits_a_hot_id(tiny):
    objects = providers(tiny).select("id", F.lit(5).cast("bigint").alias("size"))
    assert split_at_runtime(placement.attach_sizes(files_with_a_hot_id(tiny), objects))


def test_the_adders_lookup_splits_a_hot_id(tiny):
    objects = providers(tiny).select("id", F.lit(5).cast("bigint").alias("size"))
    facts = replication.known_facts(providers(tiny), objects)
    assert split_at_runtime(lookup_join(files_with_a_hot_id(tiny), facts, "id"))


def test_a_plain_join_to_an_aggregate_would_not_be_split(tiny):
    counts = replication.provider_counts(providers(tiny))
    assert not split_at_runtime(files_with_a_hot_id(tiny).join(counts, "id", "left"))
