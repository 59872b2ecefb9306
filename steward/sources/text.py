"""Manifests and patches as text.

Spark lists files whose names do not start with a dot or an underscore, and splits large
ones; a manifest of another name fails the scan, as its files would count as removed. A line keeps its place by file, block and position in the task that read it:
``ORDER`` sorts lines as a walk through the tree meets them.
"""

from __future__ import annotations

from fnmatch import fnmatch
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from steward.functions import ID_DECODED, ID_PATTERN, change_of, field, strip_op, valid_id

ORDER = ("path", "block_start", "k")

MANIFEST_FILES = "*.ks"


class Lines(NamedTuple):
    good: DataFrame
    rejected: DataFrame


def _walk_key(path: Column) -> Column:
    """A path that sorts level by level: the separator comes before any other character."""
    readable = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.translate(readable, "/", "\u0001")


def place_lines(raw: DataFrame, *others: str) -> DataFrame:
    """Add the order columns to lines read with their file path and block start."""
    return raw.select(
        _walk_key(F.col("file_path")).alias("path"),
        F.col("file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("k"),
        "value",
        *others,
    )


def refuse_hidden(spark: SparkSession, path: str, pattern: str) -> None:
    """Fail if a file that fits ``pattern`` lies under a name that Spark does not list."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(top):
        return
    root = system.getFileStatus(top).getPath().toUri().getPath()
    found = system.listFiles(top, True)
    while found.hasNext():
        at = found.next().getPath().toUri().getPath()
        inner = at[len(root) :].strip("/") or at.rsplit("/", 1)[-1]
        names = inner.split("/")
        if fnmatch(names[-1], pattern) and any(n.startswith(".") or n.startswith("_") and "=" not in n for n in names):
            raise ValueError(f"Spark does not list {at}; rename it, or leave it out by the pattern")


def scan_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    raw = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("lineSep", "\n")
        .text(path)
    )
    return place_lines(raw.select("value", "_metadata.file_path", "_metadata.file_block_start"))


def quarantine_lines(lines: DataFrame, id_pattern: str | None = None) -> Lines:
    """Split lines into (id, name) rows and rejects with a reason.

    Ids are only checked when a pattern is given, or ``ID_DECODED``.
    """
    value = F.col("value")
    read = lines.withColumn("id", field(value, 0)).withColumn("name", field(value, 1))
    reason = F.when(F.col("id") == "", "blank").when(F.col("name") == "", "one_field")
    if id_pattern is not None:
        reason = F.coalesce(reason, F.when(~valid_id(F.col("id"), id_pattern), "invalid_id"))
    judged = read.withColumn("reason", reason)
    others = [c for c in lines.columns if c != "value"]
    good = judged.filter(F.col("reason").isNull()).select(*others, "id", "name")
    rejected = judged.filter(F.col("reason").isNotNull()).select(*lines.columns, "reason")
    return Lines(good, rejected)


def scan_manifest(
    spark: SparkSession,
    path: str,
    manifest: str = "default",
    pattern: str = MANIFEST_FILES,
    id_pattern: str | None = None,
) -> Lines:
    """Manifest lines of a whole tree: (manifest, path, block_start, k, id, name), and rejects."""
    refuse_hidden(spark, path, pattern)
    lines = scan_lines(spark, path, pattern).withColumn("manifest", F.lit(manifest))
    return quarantine_lines(lines, id_pattern)


def parse_patch(lines: DataFrame, id_pattern: str = ID_DECODED) -> DataFrame:
    """Added and removed files from the lines of a unified diff.

    Context lines, headers and anything whose first field is no id are dropped. Ids are decoded, in any
    base, or held against a pattern where one is given.
    """
    value = F.col("value")
    others = [c for c in lines.columns if c != "value"]
    return (
        lines.withColumn("op", change_of(value))
        .filter(F.col("op").isNotNull())
        .select(*others, "op", strip_op(field(value, 0)).alias("id"), field(value, 1).alias("name"))
        .filter(valid_id(F.col("id"), id_pattern) & (F.col("name") != ""))
    )


def patch_rejects(lines: DataFrame, id_pattern: str = ID_DECODED) -> DataFrame:
    """Lines of a diff that add or remove something ``parse_patch`` refuses, with a reason."""
    value = F.col("value")
    id_, name = strip_op(field(value, 0)), field(value, 1)
    reason = F.when(id_ == "", "blank").when(~valid_id(id_, id_pattern), "invalid_id").when(name == "", "one_field")
    marked = lines.withColumn("op", change_of(value)).withColumn("reason", reason)
    return marked.filter(F.col("op").isNotNull() & F.col("reason").isNotNull())


def scan_patch(
    spark: SparkSession, path: str, id_pattern: str = ID_DECODED, pattern: str = "*"
) -> DataFrame:
    return parse_patch(scan_lines(spark, path, pattern), id_pattern)
