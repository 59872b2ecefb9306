"""Near-duplicates by SimHash, with pivot distance tables.

A fingerprint has a bit set where over half of the shingle hashes have it. Two fingerprints
that differ in at most ``BITS`` bits are linked, and links are followed to components.

Equal fingerprints are merged first. Those left meet where two of five blocks of their bits
are equal: three differing bits touch at most three blocks, so no link is missed. Among
those that meet, a table holds each one's distance to a number of reference fingerprints, the
pivots. By the triangle inequality the distances of a linked pair to any pivot differ by at most
``BITS``: pairs are walked in order of the first pivot distance, dropped by the largest
difference over all pivots, and only survivors are compared bit by bit. A place where very many
meet is split into tiles, each pair of which is a place of its own. Of the links
found in one place, as many are passed on as are needed to join what they join.

A null or empty text has no shingle and the fingerprint zero, and is linked like any other.
Repeated rows are copies of each other. A null id is no candidate for the smallest id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steward.llm.components import roots
from steward.llm.shared import Batches, written

SHINGLE, BITS, SEED = 3, 3, 42
BLOCKS = (13, 13, 13, 13, 12)  # two of which are equal in any two linked fingerprints
TILE = 2048  # fingerprints that meet in one place; more are split
PIVOTS = np.array(
    [xxhash.xxh64_intdigest(f"pivot {k}".encode(), SEED) for k in range(16)], dtype=np.uint64
)


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits of a whole text; ASCII capitals count as small letters."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, seed) for p in parts), dtype=">u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    set_ = (2 * counts > len(hashes)).astype(np.uint8)
    return int.from_bytes(np.packbits(set_).tobytes(), "big")


def with_fingerprints(
    docs: DataFrame, column: str = "fp", text: str = "text", shingle: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer."""
    at = docs.columns.index(text)

    def step(batches: Batches) -> Batches:
        for batch in batches:
            found = [fingerprint(t, shingle, seed) for t in batch.column(at).to_pylist()]
            prints = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, prints], [*batch.schema.names, column]
            )

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())])
    return docs.mapInArrow(step, schema)


def _places(prints: DataFrame) -> DataFrame:
    """(place, fp): every place of a fingerprint is a pair of its blocks."""
    shifts = np.cumsum((0, *BLOCKS[:-1])).tolist()
    block = [
        F.shiftright("fp", s).bitwiseAND((1 << w) - 1) for s, w in zip(shifts, BLOCKS, strict=True)
    ]
    pairs = list(combinations(range(len(BLOCKS)), 2))
    keys = [
        F.lit(n << 26) + F.shiftleft(block[i], 13) + block[j] for n, (i, j) in enumerate(pairs)
    ]
    return prints.select(F.explode(F.array(*keys)).alias("place"), "fp")


def _tiled(places: DataFrame, tile: int) -> DataFrame:
    """Places where fingerprints meet, large ones as pairs of tiles; (place, i, j, fp)."""
    sizes = places.groupBy("place").agg(F.count("*").alias("n")).filter("n > 1")
    met = places.join(sizes, "place")
    tiles = F.ceil(F.col("n") / tile).cast("int")
    own = F.pmod(F.xxhash64("fp"), tiles).cast("int")
    small = met.filter(F.col("n") <= tile).select(
        "place", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp"
    )
    large = (
        met.filter(F.col("n") > tile)
        .select("place", "fp", own.alias("t"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("u"))
        .select("place", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "fp")
    )
    return small.unionByName(large)


def _joined(prints: np.ndarray, place: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join what linked pairs within equal ``place`` values join."""
    table = np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((table[:, 0], place))
    prints, place, table = prints[order], place[order], table[order]
    first = table[:, 0]
    label = np.arange(len(prints))
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merge() -> None:
        i, j = (np.concatenate(x) for x in zip(*waiting, strict=True))
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            low = np.minimum(a, b)
            np.minimum.at(label, np.maximum(a, b), low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    left = np.arange(len(prints))
    for step in range(1, len(prints)):
        left = left[left + step < len(prints)]
        right = left + step
        left = left[(place[left] == place[right]) & (first[right] - first[left] <= bits)]
        if not len(left):
            break
        right = left + step
        near = (np.abs(table[left] - table[right]).max(axis=1) <= bits)
        i, j = left[near], right[near]
        same = np.bitwise_count(prints[i] ^ prints[j]) <= bits
        if same.any():
            waiting.append((i[same], j[same]))
            held += int(same.sum())
            if held > 1 << 18:
                merge()
                waiting.clear()
                held = 0
    if waiting:
        merge()
    moved = np.flatnonzero(label != np.arange(len(label)))
    return prints[moved].view(np.int64), prints[label[moved]].view(np.int64)


def links(prints: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to join all that are linked."""
    if bits > len(BLOCKS) - 2:
        raise ValueError(f"{len(BLOCKS)} blocks find links of at most {len(BLOCKS) - 2} bits")
    dealt = _tiled(_places(prints), tile).repartition("place", "i", "j")
    ordered = dealt.sortWithinPartitions("place", "i", "j")

    def found(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(rows)
        place = rows["place"].to_numpy()
        cell = np.stack([place, rows["i"].to_numpy(), rows["j"].to_numpy()])
        starts = np.r_[True, (cell[:, 1:] != cell[:, :-1]).any(axis=0)]
        prints = rows["fp"].to_numpy().view(np.uint64)
        a, b = _joined(prints, np.cumsum(starts), bits)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def step(batches: Batches) -> Batches:
        """Runs of rows with equal keys are kept whole across batches."""
        carried: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = np.stack([batch.column(c).to_numpy() for c in ("place", "i", "j")])
            last = cell[:, -1:]
            open_ = int((cell == last).all(axis=0)[::-1].cumprod().sum())
            head = batch.num_rows - open_
            if carried:
                before = carried[-1]
                at = before.num_rows - 1
                same = all(before.column(c)[at].as_py() == batch.column(c)[0].as_py() for c in ("place", "i", "j"))
                if same and head == 0:
                    carried.append(batch)
                    continue
            if head:
                carried.append(batch.slice(0, head))
            if carried:
                yield found(carried)
            carried = [batch.slice(head)]
        if carried:
            yield found(carried)

    return ordered.mapInArrow(step, "a bigint, b bigint").filter("a <> b").distinct()


def components(prints: DataFrame, id_: str, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint of the rows (id, fp).

    The component's id is the smallest id among all rows of its fingerprints.
    """
    distinct = written(prints.groupBy("fp").agg(F.min(id_).alias("least")), "prints")
    root = written(roots(links(distinct.select("fp"), bits, tile)), "roots")
    of = distinct.join(root, F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "least"
    )
    return of.join(
        of.groupBy("root").agg(F.min("least").alias("component_id")), "root"
    ).select("fp", "component_id")


def near_duplicates(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", bits: int = BITS, tile: int = TILE
) -> DataFrame:
    """Per row: the id, ``fingerprint`` as 16 hexadecimal digits, and ``component_id``."""
    narrow = with_fingerprints(docs.select(id_, F.col(text).alias("_text")), text="_text")
    prints = written(narrow.drop("_text"), "fingerprints")
    found = written(components(prints, id_, bits, tile), "components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select(id_, digits.alias("fingerprint"), "component_id")


def file_place(docs: DataFrame) -> list[Column] | None:
    """File and row of each document, for a table as it was read from files; else nothing.

    Not for what was joined or exploded since: there one row of a file may be many.
    """
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        docs.select(*place).schema
    except AnalysisException:
        return None
    return place


def keep_one(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", place: list[Column] | None = None
) -> DataFrame:
    """One row of each component, that with the smallest id (nulls last), with its columns.

    Exactly one of repeated rows stays. ``place`` tells rows apart, in every scan the
    same, such as ``file_place``; then no text is copied. Without it the rows are written once
    with their fingerprints and a number each.
    """
    names = docs.columns
    fp, row = "_fp", "_row"
    while fp in names or row in names:
        fp, row = fp + "_", row + "_"
    if place is None:
        numbered = with_fingerprints(docs, fp, text).withColumn(row, F.monotonically_increasing_id())
        stored = written(numbered, "numbered")
        narrow = stored.select(F.col(id_).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    else:
        stored = docs.withColumn(row, F.struct(*place))
        told = stored.select(F.col(id_).alias("id"), F.col(row).alias("row"), F.col(text).alias("_text"))
        narrow = written(with_fingerprints(told, "fp", "_text").drop("_text"), "fingerprints")
    first = narrow.groupBy("fp").agg(
        F.min(F.struct(F.col("id").isNull().alias("unknown"), "id", "row")).alias("first")
    )
    first = written(first, "prints")
    root = written(roots(links(first.select("fp"))), "roots")
    of = first.join(root, F.col("fp") == F.col("node"), "left")
    stays = of.groupBy(F.coalesce("root", "fp").alias("root")).agg(
        F.min("first").alias("first")
    )
    chosen = stays.select(F.col("first.row").alias(row))
    return stored.join(chosen, row, "left_semi").select(*names)
