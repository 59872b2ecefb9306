"""Patch files as a stream: each is folded and applied to the catalog exactly once, in its turn.

The stream carries one row per file, not its lines. Where patches are numbered, a stateful
operator holds those back that came before their turn and names the gap they wait for; else
they are taken by age, and by path where they are of one age. A batch reads the lines of all files whose turn it is, folds each
patch by itself, lets the last patch that changes a key decide on it, and records that as one change of the catalog.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from steward.functions import ID_DECODED
from steward.operators.catalog import Key, latest
from steward.operators.diff import feed_changes
from steward.operators.fold import NONE, fold_changes
from steward.sources.tables import (
    applied_files,
    compact,
    last_commit,
    read_catalog,
    touched_buckets,
    write_changes,
)
from steward.sources.text import ORDER, parse_patch, patch_rejects, place_lines

READY, HELD, LATE = "ready", "held", "late"

_FILE = "path string, file_path string, size bigint, modified timestamp, number bigint"
_TURN = f"{_FILE}, turn string, missing bigint"
_COLUMNS = ["path", "file_path", "size", "modified", "number"]


def in_turn(files: pd.DataFrame, following: int, waiting: list[dict]) -> tuple[list[dict], int, list[dict]]:
    """Judge the files that came, and those that wait: (rows, the number that is next, who waits now).

    A number below the next one, or one that came already, is late. The row of a file that is held names the
    lowest number it waits for.
    """
    rows = []
    by_number = {f["number"]: f for f in waiting}
    for file in files.sort_values(["number", "path"]).to_dict("records"):
        if file["number"] < following or file["number"] in by_number:
            rows.append({**file, "turn": LATE, "missing": None})
        else:
            by_number[file["number"]] = file
    while following in by_number:
        rows.append({**by_number.pop(following), "turn": READY, "missing": None})
        following += 1
    held = [by_number[n] for n in sorted(by_number)]
    rows += [{**file, "turn": HELD, "missing": following} for file in held]
    return rows, following, held


def _turns(files: DataFrame, first: int) -> DataFrame:
    """The files with their ``turn``. State is the next number and the few facts of each file that waits."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting = state.get if state.exists else (first, "[]")
        held = [{**f, "modified": pd.Timestamp(f["modified"])} for f in json.loads(waiting)]
        came = pd.concat(list(parts))[_COLUMNS]
        rows, following, held = in_turn(came, following, held)
        state.update((following, json.dumps([{**f, "modified": str(f["modified"])} for f in held])))
        if rows:
            out = pd.DataFrame(rows, columns=[*_COLUMNS, "turn", "missing"])
            yield out.astype({"missing": "Int64"})

    return files.withColumn("stream", F.lit("patches")).groupBy("stream").applyInPandasWithState(
        step, _TURN, "following bigint, waiting string", "update", GroupStateTimeout.NoTimeout
    )


def _identity() -> list[str]:
    return ["file_path", "size", "modified"]


def net_of_patches(changes: DataFrame, key: Key) -> DataFrame:
    """The net change per key over several patches, told apart by ``patch``, in that order.

    Patches do not fold into each other: a file added again starts over. So each is folded by
    itself, and the last one with a net change of a key counts.
    """
    each = fold_changes(changes, ORDER, [*key, "patch"])
    return latest(each.filter(F.col("change") != NONE), list(key), "patch").drop("patch")


def stream_changes(
    spark: SparkSession,
    patches: str,
    checkpoint: str,
    root: str,
    as_of: Callable[[int], str],
    key: Key = ("node_id", "id"),
    id_pattern: str = ID_DECODED,
    pattern: str = "*.patch",
    assign: Callable[[DataFrame], DataFrame] | None = None,
    source: str = "patches",
    files_per_batch: int = 1000,
    number: str | None = None,
    first: int = 0,
    rejects: str | None = None,
    compact_at: int = 8,
) -> StreamingQuery:
    """Apply the patch files that arrived since the last run, in turn, then stop.

    ``number`` is a pattern whose first group, on a file's path, is the number of the patch; numbers begin at
    ``first``. A patch that comes before its turn waits, over runs too, and one that comes after it is refused. Without ``number``
    patches are taken by age. A digest of each file (path, size and time) is committed with the change
    it led to, so a file that is handed over again, in whatever batch, is recognised and
    skipped. No file is too old to be read. ``as_of`` gives the
    time to record for a batch, and ``assign`` adds the ``node_id`` of the nodes that follow the
    patches to the changes. A batch fails where another writer changed the catalog meanwhile, and is
    applied to the new one when the stream is run again. Buckets with ``compact_at`` deltas get new bases.

    To ``rejects``, a folder, go lines that are refused, and files that are late or held, each with a reason.
    """
    if assign is None and "node_id" in key:
        raise ValueError("a catalog by node needs to know whose the changes are: give assign")
    place = F.lit(None) if number is None else F.regexp_extract("file_path", number, 1).try_cast("bigint")
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("maxFileAge", "36500d")
        .load(patches)
        .select("path", F.col("_metadata.file_path").alias("file_path"), F.col("length").alias("size"),
                F.col("modificationTime").alias("modified"))
        .withColumn("number", place.cast("bigint"))
    )
    if number is None:
        turns = files.withColumn("turn", F.lit(READY)).withColumn("missing", F.lit(None).cast("bigint"))
    else:
        turns = _turns(files.fillna(-1, ["number"]), first)

    def lines_of(session: SparkSession, ready: list[Row]) -> DataFrame:
        raw = session.read.option("lineSep", "\n").text([r.path for r in ready])
        order = session.createDataFrame([(r.file_path, k) for k, r in enumerate(ready)], "file_path string, patch bigint")
        found = place_lines(raw.select("value", "_metadata.file_path", "_metadata.file_block_start"), "file_path")
        return found.join(F.broadcast(order), "file_path").drop("file_path")

    def refuse(session: SparkSession, batch: DataFrame, lines: DataFrame | None, ready: list[Row]) -> None:
        out = batch.filter(F.col("turn") != READY).select(
            "path", F.lit(None).cast("string").alias("value"), "number",
            F.when(F.col("turn") == LATE, "late").otherwise(F.concat(F.lit("waits for "), "missing")).alias("reason"),
        )
        if lines is not None:
            names = session.createDataFrame([(k, r.path, r.number) for k, r in enumerate(ready)], "patch bigint, file string, number bigint")
            bad = patch_rejects(lines, id_pattern).join(F.broadcast(names), "patch")
            out = out.unionByName(bad.select(F.col("file").alias("path"), "value", "number", "reason"))
        told = batch.agg(F.bit_xor(F.xxhash64(*_identity(), "turn"))).first()[0]
        out.write.mode("overwrite").parquet(f"{rejects}/batch={told}")

    def apply(batch: DataFrame, at: int) -> None:
        session = batch.sparkSession
        batch = batch.withColumn("file", F.xxhash64(*_identity())).persist()
        known = applied_files(session, root, source)
        fresh = batch.filter(F.col("turn") == READY).join(known, "file", "left_anti")
        ready = sorted(fresh.collect(), key=lambda r: (r.number or 0, r.modified, r.path))  # one row per file
        lines = lines_of(session, ready) if ready else None
        if rejects is not None and not batch.isEmpty():
            refuse(session, batch, lines, ready)
        batch.unpersist()
        if lines is None:
            return
        changes = parse_patch(lines, id_pattern)
        net = net_of_patches(changes if assign is None else assign(changes), key)
        commit = last_commit(session, root)
        base = commit.version if commit else 0
        some = touched_buckets(session, root, net, base) if "node_id" not in key else []
        changed = feed_changes(read_catalog(session, root, base, some), net, as_of(at), key)
        write_changes(changed, root, at, source, [r.file for r in ready], base)
        compact(session, root, compact_at)

    return (
        turns.writeStream.foreachBatch(apply)
        .outputMode("append" if number is None else "update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
