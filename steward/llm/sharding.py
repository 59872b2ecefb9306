"""Shards of near equal bytes by histogram sort.

Rows are ordered by a hash of their text, then of their other columns, so equal texts lie
side by side. Splitters cut that order into shards, and each shard into slices that a task
can hold. To find them, candidate boundaries are probed: every partition counts exactly how
many bytes and rows lie below each probe, the counts are summed, and the probes move into the
interval where a splitter must lie, until the bytes below it are within the tolerance of what they
should be. A group of equal texts is cut only where the tolerance cannot be met otherwise.
Then the rows move, once, each to the task of its slice.

A null text has no bytes. Rows equal in all columns are never told apart, so they share a
slice. An empty table has no shards. Columns keep their names; the new ones are arguments.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steward.llm.shared import Batches, written

SHARDS = 40
OVERHEAD = 16  # bytes of a row besides its text
TOLERANCE = 0.002  # of a shard's bytes
SLICE_BYTES = 128 << 20
PROBES = 1 << 15  # in one pass, over all splitters
LEAST, MOST = -(2**63), 2**63 - 1


@dataclass
class _Bin:
    below: int  # bytes before it
    rows_below: int
    size: int
    rows: int
    low: int  # smallest and largest key in it
    high: int


def _histogram(rows: DataFrame, probes: dict[int, np.ndarray]) -> dict[int, list[_Bin]]:
    """Exact bytes, rows and key range between neighbouring probes, per group ``g``."""

    def step(batches: Batches) -> Batches:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            g, k, size = (batch.column(c).to_numpy() for c in ("g", "k", "size"))
            for group in np.unique(g):
                at, n = g == group, len(probes[group]) + 1
                keys, sizes = k[at], size[at]
                bins = np.searchsorted(probes[group], keys, side="right")
                total = seen.setdefault(
                    int(group),
                    [np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, MOST), np.full(n, LEAST)],
                )
                np.add.at(total[0], bins, sizes)
                np.add.at(total[1], bins, 1)
                np.minimum.at(total[2], bins, keys)
                np.maximum.at(total[3], bins, keys)
        for group, total in seen.items():
            full = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(full), group)), pa.array(full), *(pa.array(t[full]) for t in total)],
                ["g", "bin", "size", "rows", "low", "high"],
            )

    counted = rows.mapInArrow(step, "g bigint, bin bigint, size bigint, rows bigint, low bigint, high bigint")
    summed = counted.groupBy("g", "bin").agg(
        F.sum("size").alias("size"), F.sum("rows").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    found: dict[int, list[_Bin]] = {}
    for r in sorted(summed.collect(), key=lambda r: (r.g, r.bin)):
        bins = found.setdefault(r.g, [])
        last = bins[-1] if bins else None
        below = last.below + last.size if last else 0
        rows_below = last.rows_below + last.rows if last else 0
        bins.append(_Bin(below, rows_below, r.size, r.rows, r.low, r.high))
    return found


def _refine(
    rows: DataFrame, targets: dict[int, list[int]], tolerance: float
) -> dict[tuple[int, int], tuple[str, _Bin]]:
    """For each target of bytes below, the bin edge that meets it, or a bin of one key.

    The edge is ``low`` (a splitter before the bin's smallest key) or ``high`` (after its
    largest); ``key`` means that the bin holds one key only and no edge is near enough.
    """
    todo = {(g, t) for g, ts in targets.items() for t in ts}
    done: dict[tuple[int, int], tuple[str, _Bin]] = {}
    brackets: dict[int, set[tuple[int, int]]] = {g: {(LEAST, MOST)} for g in targets}
    while todo:
        spots = sum(len(b) for b in brackets.values())
        each = max(2, PROBES // max(1, spots))
        probes = {}
        for g, spans in brackets.items():
            points: set[int] = set()
            for low, high in spans:
                n = min(each, high - low)
                points.update(low + (high - low) * k // n for k in range(1, n + 1))
                points.add(low)
            probes[g] = np.array(sorted(points), dtype=np.int64)
        held = rows.filter(F.col("g").isin(list(probes)))
        bins = _histogram(held, probes)
        brackets = {}
        for g, t in sorted(todo):
            own = bins[g]
            at = int(np.searchsorted([b.below for b in own], t, side="right")) - 1
            b = own[max(0, at)]
            before, after = t - b.below, b.below + b.size - t
            if min(before, after) <= tolerance:
                done[g, t] = ("low" if before <= after else "high", b)
            elif b.low == b.high:
                done[g, t] = ("key", b)
            else:
                brackets.setdefault(g, set()).add((b.low, b.high))
        todo -= set(done)
    return done


@dataclass
class Splitters:
    """Boundaries in (hash, tie) order: a row belongs after those that are not above it."""

    hashes: np.ndarray
    ties: np.ndarray
    rows_below: np.ndarray
    per_shard: int

    def slices(self, h: np.ndarray, tie: np.ndarray) -> np.ndarray:
        start = np.searchsorted(self.hashes, h, side="left")
        end = np.searchsorted(self.hashes, h, side="right")
        found = start.copy()
        for i in np.unique(start[end > start]):
            at = (start == i) & (end > start)
            stop = end[at][0]
            found[at] += np.searchsorted(self.ties[i:stop], tie[at], side="right")
        return found


def splitters(
    rows: DataFrame, shards: int, tolerance: float = TOLERANCE, slice_bytes: int = SLICE_BYTES
) -> Splitters:
    """Splitters of rows (h, tie, size); the driver sees sums per interval only."""
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    per_shard = max(1, -(-total[0] // (shards * slice_bytes)))
    n = shards * per_shard
    goals = [total[0] * k // n for k in range(1, n)]
    if not total[1]:
        return Splitters(*(np.full(n - 1, v, dtype=np.int64) for v in (MOST, MOST, 0)), per_shard)
    near = tolerance * total[0] / shards
    first = _refine(rows.select(F.lit(0).cast("bigint").alias("g"), F.col("h").alias("k"), "size"), {0: sorted(set(goals))}, near)
    split: dict[int, list[int]] = {}
    for (_, t), (edge, b) in first.items():
        if edge == "key":
            split.setdefault(b.low, []).append(t - b.below)
    second = {}
    if split:
        hot = sorted(split)
        number = F.coalesce(*[F.when(F.col("h") == h, F.lit(i)) for i, h in enumerate(hot)])
        inner = rows.filter(F.col("h").isin(hot)).select(number.cast("bigint").alias("g"), F.col("tie").alias("k"), "size")
        second = _refine(inner, {i: sorted(set(split[h])) for i, h in enumerate(hot)}, near)
    found = []
    for t in goals:
        edge, b = first[0, t]
        if edge == "key":
            base, h = b, b.low
            edge, b = second[hot.index(h), t - base.below]
            if edge == "key":  # rows that nothing tells apart: the nearer side
                edge = "low" if (t - base.below) - b.below <= b.below + b.size - (t - base.below) else "high"
            below = base.rows_below + b.rows_below + (b.rows if edge == "high" else 0)
            if edge == "low":
                found.append((h, b.low, below))
            else:
                found.append((h, b.high + 1, below) if b.high < MOST else (h + 1, LEAST, below))
        else:
            below = b.rows_below + (b.rows if edge == "high" else 0)
            key = b.low if edge == "low" else min(b.high, MOST - 1) + 1
            found.append((key, LEAST, below))
    found.sort()
    return Splitters(*(np.array(c, dtype=np.int64) for c in zip(*found, strict=True)), per_shard) if found else Splitters(
        *(np.zeros(0, dtype=np.int64) for _ in range(3)), per_shard
    )


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    text: str = "text",
    shard_as: str = "shard",
    slot_as: str = "slot",
    tolerance: float = TOLERANCE,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` with the shard of each row, from 0, and its slot there, gapless from 0."""
    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c != text]
    h, tie, part = "_h", "_tie", "_slice"
    while {h, tie, part} & set(names):
        h, tie, part = h + "_", tie + "_", part + "_"
    keyed = docs.withColumns({h: F.xxhash64(text), tie: F.xxhash64(*others) if others else F.lit(0).cast("bigint")})
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD
    narrow = written(keyed.select(F.col(h).alias("h"), F.col(tie).alias("tie"), size.alias("size")), "keys")
    cuts = splitters(narrow, shards, tolerance, slice_bytes)
    n = len(cuts.hashes) + 1

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            k = cuts.slices(*(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in (h, tie)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(k.astype(np.int32))], [*batch.schema.names, part]
            )

    def number(batches: Batches) -> Batches:
        starts = np.r_[0, cuts.rows_below]
        seen: dict[int, int] = {}
        for batch in batches:
            k = batch.column(batch.schema.get_field_index(part)).to_numpy()
            slot = np.zeros(len(k), dtype=np.int64)
            for piece in np.unique(k):
                at = np.flatnonzero(k == piece)
                begin = seen.get(int(piece), 0)
                base = starts[piece] - starts[piece // cuts.per_shard * cuts.per_shard]
                slot[at] = base + begin + np.arange(len(at))
                seen[int(piece)] = begin + len(at)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array((k // cuts.per_shard).astype(np.int32)), pa.array(slot)],
                [*batch.schema.names[: len(names)], shard_as, slot_as],
            )

    dealt = keyed.mapInArrow(deal, T.StructType([*keyed.schema.fields, T.StructField(part, T.IntegerType())]))
    placed = dealt.repartitionById(n, F.col(part)).sortWithinPartitions(part, h, tie)
    added = [T.StructField(shard_as, T.IntegerType()), T.StructField(slot_as, T.LongType())]
    return placed.mapInArrow(number, T.StructType([*docs.schema.fields, *added]))
