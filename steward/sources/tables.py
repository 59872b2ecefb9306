"""Catalog snapshots and observation tables in Parquet, and report messages as text.

A catalog lies in buckets by the hash of its ids. A snapshot is a record of folders: bases hold rows by
bucket and status, and deltas hold what changed since, put or gone, by bucket. A reader takes the last change of a
key, and its base row where there is none; so a few changes write a few small files, open no more than
the buckets of their ids, and leave all else in place. ``compact`` makes new bases of buckets with many deltas.
With each snapshot go digests of its leaves, kept up by every write, which tell where another list of files differs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steward.schemas import CATALOG, CATALOG_COLUMNS, COMMIT, DIGEST, DIGESTS, PINS, PROVIDERS, SEEN
from steward.session import settle
from steward.sources.digests import bucket_of, combined, leaf_digests, placed

# Of a new catalog; it keeps the number it starts with. A bucket should suit a task.
BUCKETS = 16

GONE = "gone"

_PLACE = [T.StructField("v", T.StringType()), T.StructField("bucket", T.IntegerType())]
_BASE = T.StructType([*CATALOG.fields, *_PLACE])
_DELTA = T.StructType(
    [*[T.StructField(f.name, f.dataType) for f in CATALOG], T.StructField(GONE, T.BooleanType()), *_PLACE]
)


class Commit(NamedTuple):
    version: int
    batch: int | None


def _commits(root: str) -> str:
    return f"{root}/commits"


class StaleCatalog(RuntimeError):
    """Another writer recorded a snapshot after the one this catalog was made from."""


def _log(spark: SparkSession, root: str) -> DataFrame | None:
    """The records of all snapshots, or nothing where there is none yet."""
    try:
        return spark.read.schema(COMMIT).json(f"{_commits(root)}/*.json")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _record(spark: SparkSession, root: str, commit: dict) -> bool:
    """Record a snapshot, unless its version is taken: the record is renamed into place, never over another.

    The file system must refuse such a rename as one step, as HDFS does.
    """
    hadoop, settings = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    folder = hadoop.Path(_commits(root))
    files = folder.getFileSystem(settings)
    files.mkdirs(folder)
    draft = hadoop.Path(folder, f".{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(json.dumps(commit).encode())
    out.close()
    context = hadoop.FileContext.getFileContext(files.makeQualified(folder).toUri(), settings)
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(draft, hadoop.Path(folder, f"{commit['version']:012d}.json"), options)
    except Py4JJavaError as refused:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in refused.java_exception.getClass().getName():
            return False
        raise
    return True


def last_commit(spark: SparkSession, root: str, source: str | None = None) -> Commit | None:
    """The newest complete snapshot, and the last batch taken in from ``source``."""
    log = _log(spark, root)
    if log is None:
        return None
    mine = F.col("source").eqNullSafe(F.lit(source))
    row = log.agg(F.max("version"), F.max(F.when(mine, F.col("batch")))).first()
    return Commit(*row) if row[0] is not None else None


def taken_in(spark: SparkSession, root: str, source: str, batch: int) -> bool:
    """Whether a snapshot records that ``batch`` of ``source`` went into it."""
    log = _log(spark, root)
    if log is None:
        return False
    return not log.filter((F.col("source") == source) & (F.col("batch") == batch)).isEmpty()


def applied_files(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Identities of the files of ``source`` that went into the catalog so far."""
    log = _log(spark, root)
    if log is None:
        return spark.createDataFrame([], "file bigint")
    return log.filter(F.col("source") == source).select(F.explode("files").alias("file"))


def _state(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """The record of a snapshot, by default the newest."""
    log = _log(spark, root)
    if log is None or version == 0:
        return None
    wanted = log if version is None else log.filter(F.col("version") == version)
    record = wanted.agg(F.max_by(F.struct(*log.columns), "version").alias("r")).first()["r"]
    if record is None:
        raise ValueError(f"no snapshot {version} of {root}")
    return record.asDict(recursive=True)


def _folders(spark: SparkSession, root: str, schema: T.StructType, folders: list[dict], only: Iterable[int] | None) -> DataFrame:
    """Rows of some folders in one scan, of the buckets for which each still counts."""
    wanted = None if only is None else set(only)
    live = [(f["folder"], sorted(set(f["buckets"]) if wanted is None else wanted & set(f["buckets"]))) for f in folders]
    live = [(folder, buckets) for folder, buckets in live if buckets]
    if not live:
        return spark.createDataFrame([], schema)
    counts = reduce(or_, [(F.col("v") == folder[2:]) & F.col("bucket").isin(buckets) for folder, buckets in live])
    paths = [f"{root}/{folder}" for folder, _ in live]
    return spark.read.schema(schema).option("basePath", root).parquet(*paths).filter(counts)


def _last_changes(changed: DataFrame) -> DataFrame:
    """The last change of each key, later versions over earlier ones."""
    row = F.struct(*CATALOG_COLUMNS, GONE)
    order = F.substring_index("v", "-", 1).cast("bigint")
    return changed.groupBy(F.col("node_id").alias("_node"), F.col("id").alias("_id")).agg(F.max_by(row, order).alias("r"))


def _merged(spark: SparkSession, root: str, state: dict, only: Iterable[int] | None = None) -> DataFrame:
    base = _folders(spark, root, _BASE, state["bases"], only).select(*CATALOG_COLUMNS)
    if not any(f["buckets"] for f in state["deltas"]):
        return base
    last = _last_changes(_folders(spark, root, _DELTA, state["deltas"], only))
    same = (F.col("node_id") == F.col("_node")) & (F.col("id") == F.col("_id"))
    put = last.filter(~F.col(f"r.{GONE}")).select(*[F.col(f"r.{c}").alias(c) for c in CATALOG_COLUMNS])
    return base.join(last.select("_node", "_id"), same, "left_anti").unionByName(put)


def read_catalog(
    spark: SparkSession, root: str, version: int | None = None, buckets: Iterable[int] | None = None
) -> DataFrame:
    """The newest snapshot, or a given one; empty where nothing was written yet, and at version 0.

    With ``buckets`` only those are opened.
    """
    state = _state(spark, root, version)
    return spark.createDataFrame([], CATALOG) if state is None else _merged(spark, root, state, buckets)


def touched_buckets(spark: SparkSession, root: str, ids: DataFrame, version: int | None = None) -> list[int]:
    """The buckets of some rows' ids; at most as many numbers as there are buckets."""
    state = _state(spark, root, version)
    buckets = state["buckets"] if state else BUCKETS
    return sorted(r[0] for r in ids.select(bucket_of(F.col("id"), buckets)).distinct().collect())


def catalog_digests(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, int]:
    """(digests of the leaves of a snapshot, its number of buckets); no data file of the catalog is opened.

    A snapshot recorded without digests has them made from its rows.
    """
    state = _state(spark, root, version)
    if state is None:
        return spark.createDataFrame([], DIGEST), BUCKETS
    if state["digests"] is None:
        return leaf_digests(_merged(spark, root, state), state["buckets"]), state["buckets"]
    return _digests(spark, root, state["digests"]), state["buckets"]


def _digests(spark: SparkSession, root: str, folders: Sequence[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], DIGEST)
    return combined(spark.read.schema(DIGEST).parquet(*[f"{root}/{f}" for f in folders]))


def _write_digests(digests: DataFrame, root: str, folder: str) -> str:
    name = f"digests-{folder}"
    digests.write.parquet(f"{root}/{name}")
    return name


def rows_of_leaves(rows: DataFrame, leaves: DataFrame, buckets: int) -> DataFrame:
    """Those ``rows`` that lie in some leaves; ``leaves`` is a small table of bucket and leaf."""
    return placed(rows, buckets).join(leaves, ["bucket", "leaf"], "left_semi").drop("bucket", "leaf")


def _base_version(spark: SparkSession, root: str, base: int | None) -> int:
    commit = last_commit(spark, root)
    newest = commit.version if commit else 0
    if base is not None and base != newest:
        raise StaleCatalog(f"{root} is at {newest}, not at {base}")
    return newest


def _new_folder(version: int) -> str:
    return f"v={version}-{uuid.uuid4().hex}"


def _discard(spark: SparkSession, root: str, folders: Sequence[str | None]) -> None:
    """Delete folders that no record names."""
    for folder in filter(None, folders):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{folder}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _write_lists(root: str, version: int, lists: dict[str, DataFrame] | None) -> str | None:
    if not lists:
        return None
    folder = f"lists-{_new_folder(version)}"
    for name, rows in lists.items():
        rows.write.parquet(f"{root}/{folder}/{name}")
    return folder


def read_list(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table that a snapshot, by default the newest, was recorded with."""
    state = _state(spark, root, version)
    if state is None or state["lists"] is None:
        raise ValueError(f"no lists with snapshot {version or 'of'} {root}")
    return spark.read.parquet(f"{root}/{state['lists']}/{name}")


def _keep(spark: SparkSession, root: str, record: dict, made: Sequence[str | None]) -> int:
    """Record a snapshot; one that comes too late leaves nothing behind."""
    if not _record(spark, root, record):
        _discard(spark, root, made)
        raise StaleCatalog(f"{root} has got a version {record['version']} meanwhile")
    return record["version"]


def _write_base(rows: DataFrame, path: str, buckets: int) -> None:
    """One task and file per bucket and status, unless Spark splits a large one."""
    (
        rows.select(*CATALOG_COLUMNS, bucket_of(F.col("id"), buckets).alias("bucket"))
        .repartition("bucket")
        .sortWithinPartitions("bucket", "status", "id")
        .write.partitionBy("bucket", "status")
        .parquet(path)
    )


def write_catalog(
    catalog: DataFrame,
    root: str,
    batch: int | None = None,
    source: str | None = None,
    key: Sequence[str] = ("node_id", "id"),
    base: int | None = None,
    buckets: int | None = None,
    lists: dict[str, DataFrame] | None = None,
) -> int:
    """Write the next snapshot whole, then record it; a reader never sees an unrecorded one.

    ``base`` is the version the catalog was made from, 0 for none; by default the newest one
    as the write begins. Where another snapshot has been recorded since, nothing is and
    ``StaleCatalog`` is raised. A row without node or id, or a second row of a ``key``, is an error. Neither
    leaves anything behind.

    ``lists`` are tables that belong to the snapshot, such as what is to be unpinned; they count once it is
    recorded. Files are sorted by id within bucket and status, so that a read by
    status opens only its part and a lookup skips row groups.
    """
    spark = catalog.sparkSession
    newest = _base_version(spark, root, base)
    if buckets is None:
        state = _state(spark, root, newest)
        buckets = state["buckets"] if state else BUCKETS
    version = newest + 1
    folder = _new_folder(version)
    bases = [{"folder": folder, "buckets": list(range(buckets))}]
    made = [folder]
    try:
        _write_base(catalog, f"{root}/{folder}", buckets)
        stored = _folders(spark, root, _BASE, bases, None)
        _check_keys(stored, key)
        made.append(_write_digests(leaf_digests(stored, buckets), root, folder))
        made.append(_write_lists(root, version, lists))
    except Exception:
        _discard(spark, root, made)
        raise
    record = {
        "version": version, "batch": batch, "source": source, "files": [], "buckets": buckets, "bases": bases, "deltas": [],
        "lists": made[2], "digests": [made[1]],
    }
    return _keep(spark, root, record, made)


def write_changes(
    changes: DataFrame,
    root: str,
    batch: int | None = None,
    source: str | None = None,
    files: Sequence[int] = (),
    base: int | None = None,
    lists: dict[str, DataFrame] | None = None,
) -> int:
    """Record changed rows over the newest snapshot: catalog columns, and ``gone`` where a key is taken out.

    One row per node and id. Only these rows are checked and written, into the buckets of their ids. ``files``
    are identities of what the changes came from. Without any change the record still counts. ``lists`` as
    for ``write_catalog``.
    """
    spark = changes.sparkSession
    newest = _base_version(spark, root, base)
    state = _state(spark, root, newest) or {"buckets": BUCKETS, "bases": [], "deltas": [], "digests": []}
    rows = settle(changes.select(*CATALOG_COLUMNS, GONE, bucket_of(F.col("id"), state["buckets"]).alias("bucket")))
    _check_keys(rows, ("node_id", "id"))
    touched = sorted(r[0] for r in rows.select("bucket").distinct().collect())
    version = newest + 1
    deltas, digests, made = list(state["deltas"]), state["digests"], [None, None, None]
    try:
        if touched:
            made[0] = _new_folder(version)
            ordered = rows.repartition("bucket").sortWithinPartitions("bucket", "id")
            ordered.write.partitionBy("bucket").parquet(f"{root}/{made[0]}")
            deltas.append({"folder": made[0], "buckets": touched})
            if digests is not None:
                before = _merged(spark, root, state, touched).join(rows.select("node_id", "id"), ["node_id", "id"], "left_semi")
                turned = leaf_digests(rows.filter(~F.col(GONE)), state["buckets"]).unionByName(
                    leaf_digests(before, state["buckets"], sign=-1)
                )
                made[2] = _write_digests(combined(turned), root, made[0])
                digests = [*digests, made[2]]
        made[1] = _write_lists(root, version, lists)
    except Exception:
        _discard(spark, root, made)
        raise
    record = {**state, "version": version, "batch": batch, "source": source, "files": list(files), "deltas": deltas, "lists": made[1], "digests": digests}
    return _keep(spark, root, record, made)


def compact(spark: SparkSession, root: str, least: int = 8) -> list[int]:
    """New bases for the buckets with ``least`` deltas or more; gives those buckets. No row changes."""
    newest = _base_version(spark, root, None)
    state = _state(spark, root, newest)
    if state is None:
        return []
    every = [b for f in state["deltas"] for b in f["buckets"]]
    full = sorted(b for b in set(every) if every.count(b) >= least)
    if not full:
        return []
    version = newest + 1
    folder = _new_folder(version)
    _write_base(_merged(spark, root, state, full), f"{root}/{folder}", state["buckets"])
    made, digests = [folder], state["digests"]
    if digests is not None:
        made.append(_write_digests(_digests(spark, root, digests), root, folder))
        digests = made[1:]

    def without(folders: list[dict]) -> list[dict]:
        left = [{**f, "buckets": [b for b in f["buckets"] if b not in full]} for f in folders]
        return [f for f in left if f["buckets"]]

    bases = [*without(state["bases"]), {"folder": folder, "buckets": full}]
    record = {**state, "version": version, "batch": None, "source": None, "files": [], "bases": bases, "deltas": without(state["deltas"]), "lists": None, "digests": digests}
    _keep(spark, root, record, made)
    return full


def _check_keys(stored: DataFrame, key: Sequence[str]) -> None:
    """Counts combine before the shuffle, so a key repeated often does no harm."""
    lacks = F.col("node_id").isNull() | F.col("id").isNull()
    counts = stored.groupBy(*key).agg(F.count("*").alias("rows"), F.max(lacks).alias("lacks"))
    bad = counts.filter((F.col("rows") > 1) | F.col("lacks")).first()
    if bad is not None:
        raise ValueError(f"a catalog needs a node, an id and one row per {tuple(key)}: {bad}")


def scan_providers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROVIDERS).parquet(path)


def write_seen(seen: DataFrame, root: str) -> None:
    """Add rows of ``replication.last_seen`` to those kept at ``root``, a folder per period.

    Nothing kept before is read. A period with most of the rows is split over tasks and files.
    """
    seen.hint("rebalance", "period").write.mode("append").partitionBy("period").parquet(root)


def read_seen(spark: SparkSession, root: str) -> DataFrame:
    """All rows kept at ``root``; a filter by ``period`` leaves the folders of others unopened."""
    return spark.read.schema(SEEN).parquet(root)


def forget_seen(spark: SparkSession, root: str, period: int) -> list[int]:
    """Delete the folders of periods before ``period`` that counts need no more; gives those."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for at in files.listStatus(top):
        name = at.getPath().getName()
        number = name.removeprefix("period=")
        if name != number and number.lstrip("-").isdigit() and int(number) < period:
            files.delete(at.getPath(), True)
            gone.append(int(number))
    return sorted(gone)


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """Digests of blocks kept at ``root``, each once though a job that failed may have added some twice; none at first."""
    try:
        return spark.read.schema(DIGESTS).parquet(root).distinct()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DIGESTS)


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PINS).parquet(path)


def report_messages(reports: DataFrame) -> DataFrame:
    """One JSON message per node."""
    return reports.select(F.to_json(F.struct("email", "total_space", "used_space")).alias("value"))


def write_reports(reports: DataFrame, path: str) -> None:
    report_messages(reports).write.mode("overwrite").text(path)
