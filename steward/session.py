"""Session helpers: a tuned local session, and where intermediate tables settle."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A table of narrow rows is broadcast on our word only when a count has shown it to have
# no more rows than this; beyond that Spark decides by itself.
BROADCAST_ROWS = 200_000


def local_session(app: str = "steward", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the jobs are written for.

    On a cluster the same settings belong in ``spark-defaults``; nothing in the
    library sets them on a session it was handed.
    """
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The folder all executors share, taken from ``spark.checkpoint.dir``.

    Only a session without that setting, as in local tests, gets a folder of its own.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    alone = re.fullmatch(r"local(\[.*\])?", context.master)  # a local cluster has executors of its own
    if not configured and not alone:
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="steward-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for a table a job writes and reads back."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """Evaluate ``df`` once into the shared folder and cut its lineage.

    Used where several branches must see the very same rows, or a loop would
    otherwise grow its plan. The copy survives the loss of an executor.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def laid_out(df: DataFrame, by: str, parts: int) -> DataFrame:
    """``df`` written once in buckets by a column, under the shared folder.

    A join by that column with as many partitions leaves it where it is and shuffles the other side alone.
    """
    spark = df.sparkSession
    name = f"laid_out_{uuid.uuid4().hex}"
    rows = df.repartition(parts, by).write.bucketBy(parts, by).sortBy(by)
    rows.option("path", scratch_path(spark, name)).format("parquet").saveAsTable(name)
    return spark.table(name)
