"""Sizes, room on nodes, and what fits where."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steward.operators.joins import lookup_join, small_side
from steward.operators.running import running, running_over_slices, sliced, without_slices
from steward.schemas import LOCAL
from steward.session import BROADCAST_ROWS, scratch_path, settle

NEED_ORDER = ("replications", "id")

# A node with more contested candidates than this is worked on by many tasks at once.
GROUP_ROWS = 200_000


def attach_sizes(files: DataFrame, objects: DataFrame) -> DataFrame:
    """Each file with ``object_size``, null when its size is unknown."""
    sizes = objects.groupBy("id").agg(F.max("size").alias("object_size"))
    return lookup_join(files, sizes, "id")


def used_bytes(catalog: DataFrame) -> DataFrame:
    """Bytes each node stores."""
    stored = F.when(F.col("status") == LOCAL, F.col("size"))
    return catalog.groupBy("node_id").agg(F.coalesce(F.sum(stored), F.lit(0)).alias("used"))


def node_room(nodes: DataFrame, used: DataFrame) -> DataFrame:
    """What each node may still take, from its ``max_bytes`` and the bytes in use."""
    room = F.col("max_bytes") - F.coalesce("used", F.lit(0))
    return nodes.join(used, "node_id", "left").select("node_id", room.alias("room"))


def with_room(files: DataFrame, rooms: DataFrame) -> DataFrame:
    """Each file with the room of its node in ``_room``; an unknown node has none."""
    room = small_side(rooms.select("node_id", F.col("room").alias("_room")))
    return files.join(room, "node_id", "left").withColumn(
        "_room", F.coalesce("_room", F.lit(0)).cast("bigint")
    )


def fit_capacity(
    candidates: DataFrame,
    rooms: DataFrame,
    mode: str = "greedy",
    order: Sequence[str] = NEED_ORDER,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Mark with ``fits`` the candidates their node takes, going through them in order.

    ``greedy`` skips a file that does not fit and goes on with the next one. ``prefix``
    is stricter: it counts skipped files as if they had been taken. A file must be
    smaller than the room left; one of just that size does not fit.
    """
    placed = with_room(candidates, rooms)
    return fit_placed(placed if mode == "prefix" else settle(placed), mode, order, group_rows)


def fit_placed(
    placed: DataFrame,
    mode: str = "greedy",
    order: Sequence[str] = NEED_ORDER,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """``fit_capacity`` for settled candidates that have their ``_room`` already."""
    if mode == "prefix":
        return _fit_prefix(placed, order)
    if mode == "greedy":
        return _fit_greedy(placed, order, group_rows)
    raise ValueError(f"unknown mode {mode!r}")


def _fit_prefix(placed: DataFrame, order: Sequence[str]) -> DataFrame:
    able = F.col("size") < F.col("_room")
    size = F.when(able, F.col("size")).otherwise(F.lit(0))
    total = running(placed, ["node_id"], order, totals={"_total": size})
    fits = able & (F.col("_total") < F.col("_room"))
    return total.withColumn("fits", F.coalesce(fits, F.lit(False))).drop("_room", "_total")


def _fit_greedy(placed: DataFrame, order: Sequence[str], group_rows: int) -> DataFrame:
    """Greedy fit. Most nodes need no walk at all, and none is walked whole in one task.

    Room only shrinks, so a file as large as the room at the start never fits. Where all
    others fit together, they all do. What is left is walked per node if it is short,
    and otherwise by an index over its slices.
    """
    able = F.col("size") < F.col("_room")
    way = (
        F.when(F.col("_sum") < F.col("_max"), "all")
        .when(F.col("_n") <= group_rows, "walk")
        .otherwise("rounds")
    )
    load = (
        placed.filter(able)
        .groupBy("node_id")
        .agg(F.count("*").alias("_n"), F.sum("size").alias("_sum"), F.max("_room").alias("_max"))
        .select("node_id", way.alias("_way"))
    )
    ways = {row["_way"]: row["count"] for row in load.groupBy("_way").count().collect()}
    load = F.broadcast(load) if sum(ways.values()) <= BROADCAST_ROWS else settle(load)
    routed = placed.join(load, "node_id", "left")
    columns = [*[c for c in placed.columns if c != "_room"], "fits"]

    going = able & F.col("_way").isin("walk", "rounds")
    fits = F.coalesce(able & (F.col("_way") == "all"), F.lit(False))
    result = routed.filter(~F.coalesce(going, F.lit(False))).withColumn("fits", fits).select(*columns)
    for name in ("walk", "rounds"):
        if name in ways:
            part = routed.filter(able & (F.col("_way") == name)).select(*placed.columns)
            solved = _walk(part, order) if name == "walk" else _rounds(part, order, group_rows)
            result = result.unionByName(solved.select(*columns))
    return result


def first_fit(sizes: list[int], room: int) -> list[bool]:
    """Which of the sizes fit, taken in order."""
    fits = []
    for size in sizes:
        fits.append(size < room)
        if size < room:
            room -= size
    return fits


Step = Callable[[pa.Table, list[tuple[int, int]]], pa.Table]


def _runs(table: pa.Table | pa.RecordBatch, keys: Sequence[str]) -> list[tuple[int, int]]:
    """From where to where rows have the same keys."""
    found = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
    starts = [i for i, key in enumerate(found) if not i or key != found[i - 1]]
    return list(zip(starts, [*starts[1:], len(found)], strict=True))


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], step: Step) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut anew so that none ends within a group."""
    held: list[pa.RecordBatch] = []  # the last group, which may go on
    last = None

    def done(pieces: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pieces:
            table = pa.Table.from_batches(pieces)
            yield from step(table, _runs(table, keys)).to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        start = _runs(batch, keys)[-1][0]
        first, end = (tuple(batch.column(k)[i].as_py() for k in keys) for i in (0, start))
        if first != last:
            yield from done(held)
            held = []
        if start:
            yield from done([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
        last = end
    yield from done(held)


def _by_group(rows: DataFrame, keys: Sequence[str], order: Sequence[str], step: Step, schema: str | T.StructType) -> DataFrame:
    """``step`` for all groups, many at a time: small groups have no call and no batch each.

    It gets a table of whole groups, the rows of each in order, and where each starts and ends.
    """
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(lambda batches: _whole_groups(batches, keys, step), schema)


def _first_fits(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Array:
    """``first_fit`` of each group, in the room its first row has."""
    sizes, rooms = table.column("size").to_pylist(), table.column("_room").to_pylist()
    return pa.array([fit for a, b in groups for fit in first_fit(sizes[a:b], rooms[a])], pa.bool_())


def _walk(placed: DataFrame, order: Sequence[str]) -> DataFrame:
    def step(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        return table.append_column("fits", _first_fits(table, groups))

    schema = T.StructType([*placed.schema.fields, T.StructField("fits", T.BooleanType())])
    return _by_group(placed, ["node_id"], order, step, schema)


# Candidates of long nodes are stored in at most so many parts, of which a round opens some.
PARTS = 1024

_INDEX = "node_id string, _slice_no bigint, _class bigint, _bytes bigint, _need bigint"
_SPANS = "node_id string, _from bigint, _to bigint, _cut bigint, _open bigint, _room bigint"


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    """A table of these rows, whose first column is text and all others numbers."""
    names = [part.split()[0] for part in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = [pa.string(), *[pa.int64()] * (len(names) - 1)]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


_POWERS = np.array([1 << k for k in range(63)], dtype=np.int64)


def size_class(sizes: np.ndarray) -> np.ndarray:
    """0 for 0, and k for sizes from 2^(k-1) to 2^k - 1."""
    return np.searchsorted(_POWERS, sizes, side="right")


def index_of(sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """Per size class: (class, bytes, the room from which on a file of the class is taken).

    With a room of that class, all files of lower classes are taken on the way as long as the room stays in it. So a file needs
    its own size and theirs, of those before it, and the file that needs least tells for all.
    """
    classes = size_class(sizes)
    out = []
    for k in np.unique(classes).tolist():
        mine = classes == k
        before = np.cumsum(np.where(classes < k, sizes, 0))
        out.append((k, int(sizes[mine].sum()), int((sizes + before)[mine].min())))
    return out


def next_event(index: list[tuple[int, int, int, int]], room: int, start: int) -> tuple[list[tuple[int, int, int]], int | None, int]:
    """Skip slices in which nothing but files of lower classes than the room's are taken.

    ``index`` has rows (slice, class, bytes, need) in order. Gives spans (from, to, cut), within which files
    below ``cut`` are taken and no others, the slice to open, if any, and the room at its start.
    """
    if not index or start > index[-1][0]:
        return [], None, room
    if room <= 0:
        return [(start, index[-1][0] + 1, 0)], None, room
    klass = room.bit_length()
    cut = 1 << (klass - 1)
    for at, rows in groupby((r for r in index if r[0] >= start), key=itemgetter(0)):
        rows = list(rows)
        small = sum(r[2] for r in rows if r[1] < klass)
        need = next((r[3] for r in rows if r[1] == klass), None)
        if room - small < cut or need is not None and need < room:
            return [(start, at, cut)] if at > start else [], at, room
        room -= small
    return [(start, index[-1][0] + 1, cut)], None, room


def _rounds(placed: DataFrame, order: Sequence[str], group_rows: int, opened: list[int] | None = None) -> DataFrame:
    """The same walk for nodes too large for one task: an index says which slices need one.

    The files of a node are cut into slices of ``group_rows``, in order. Let the room be at least 2^j and below 2^(j+1).
    As long as it stays so, every file below 2^j fits; of the others only the first that fits can be taken, since the room is below 2^j
    afterwards. An index by slice and size class tells in which slice the room leaves its class; all
    before it are decided by their sizes alone. That slice is opened and walked, and the room has
    at least halved after it, so a node opens 63 slices at most. A round opens one of each node.
    ``opened`` gets the rows of the parts read per round.
    """
    spark = placed.sparkSession
    group_rows = max(1, group_rows)
    n_parts = min(PARTS, placed.count() // group_rows + 1)
    slice_of = F.expr(f"(_pos - 1) div {group_rows}")
    ranked = running_over_slices(sliced(placed, ["node_id"], order), ["node_id"], order, rank="_pos")
    part = F.pmod(F.xxhash64("node_id", "_slice_no"), F.lit(n_parts)).cast("int")
    path = scratch_path(spark, "candidates")
    numbered = without_slices(ranked, ["node_id"]).withColumn("_slice_no", slice_of).withColumn("_part", part)
    numbered.repartition("_part").sortWithinPartitions("_part", "node_id", "_pos").write.partitionBy("_part").parquet(path)
    files = spark.read.schema(numbered.schema).parquet(path)

    def per_slice(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        nodes, slices = table.column("node_id").to_pylist(), table.column("_slice_no").to_pylist()
        sizes = table.column("size").to_numpy()
        return _rows([(nodes[a], slices[a], *f) for a, b in groups for f in index_of(sizes[a:b])], _INDEX)

    narrow = files.select("node_id", "_slice_no", "_pos", "size")
    index = settle(_by_group(narrow, ["node_id", "_slice_no"], ["_pos"], per_slice, _INDEX))

    def per_node(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        out = []
        nodes, rooms, after = (table.column(c).to_pylist() for c in ("node_id", "_room", "_after"))
        known = list(zip(*(table.column(c).to_pylist() for c in ("_slice_no", "_class", "_bytes", "_need")), strict=True))
        for a, b in groups:
            spans, at, room = next_event(known[a:b], rooms[a], after[a])
            out += [(nodes[a], *span, None, None) for span in spans]
            if at is not None:
                out.append((nodes[a], None, None, None, at, room))
        return _rows(out, _SPANS)

    def per_open(table: pa.Table, groups: list[tuple[int, int]]) -> pa.Table:
        return table.append_column("_fits", _first_fits(table, groups))

    walked_schema = "node_id string, _slice_no bigint, _pos bigint, size bigint, _room bigint, _fits boolean"
    state = files.groupBy("node_id").agg(F.max("_room").alias("_room")).withColumn("_after", F.lit(0).cast("bigint"))
    spans, walks = [], []
    while True:
        ahead = index.join(state, "node_id").filter(F.col("_slice_no") >= F.col("_after"))
        step = settle(_by_group(ahead, ["node_id"], ["_slice_no", "_class"], per_node, _SPANS))
        spans.append(step.filter(F.col("_from").isNotNull()).select("node_id", "_from", "_to", "_cut"))
        to_open = step.filter(F.col("_open").isNotNull()).select("node_id", F.col("_open").alias("_slice_no"), "_room")
        parts = [r[0] for r in to_open.select(part).distinct().collect()]
        if not parts:
            break
        some = files.filter(F.col("_part").isin(parts)).select("node_id", "_slice_no", "_pos", "size")
        if opened is not None:
            opened.append(some.count())
        asked = some.join(to_open, ["node_id", "_slice_no"])
        walk = settle(_by_group(asked, ["node_id", "_slice_no"], ["_pos"], per_open, walked_schema))
        walks.append(walk.select("node_id", "_pos", "_fits"))
        taken = F.coalesce(F.sum(F.when(F.col("_fits"), F.col("size"))), F.lit(0))
        state = walk.groupBy("node_id").agg(
            (F.max("_room") - taken).alias("_room"), (F.max("_slice_no") + 1).alias("_after")
        )
    per_span = reduce(DataFrame.unionByName, spans).groupBy("node_id").agg(
        F.collect_list(F.struct("_from", "_to", "_cut")).alias("_spans")  # 64 a node at most
    )
    rows = files.join(small_side(per_span), "node_id", "left")

    def below(span):
        return (F.col("_slice_no") >= span["_from"]) & (F.col("_slice_no") < span["_to"]) & (F.col("size") < span["_cut"])

    by_size = F.coalesce(F.exists("_spans", below), F.lit(False))
    if walks:
        rows = rows.join(reduce(DataFrame.unionByName, walks), ["node_id", "_pos"], "left")
        by_size = F.coalesce("_fits", by_size)
    return rows.withColumn("fits", by_size).select(*[c for c in placed.columns if c != "_room"], "fits")
