"""What several operators need: tables in, Arrow batches through, tables written once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steward.session import scratch_path

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` evaluated once into the shared folder and read back.

    Later readers prune its columns, and the loss of an executor costs no rerun.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batches_of(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices, so that what is derived from long texts stays small."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def batches_by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``most`` bytes of a text column, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = before = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start, before = stop, int(ends[stop - 1])


def mapped(df: DataFrame, step: Callable[[Batches], Batches], schema: str) -> DataFrame:
    return df.mapInArrow(step, schema)


def small_by_bytes(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """A written table, marked for broadcast if its bytes are few; beyond that Spark decides."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    total = sum(sizes, F.lit(16 * len(df.columns)))
    return F.broadcast(df) if (df.agg(F.sum(total)).first()[0] or 0) <= most else df
