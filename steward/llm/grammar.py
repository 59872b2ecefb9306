"""Token ids in files compressed by a grammar of frequent pairs (Re-Pair).

Documents are ordered by id and cut into shards; a shard is a row of the file with a grammar of
its own. Its ids are rewritten by replacing frequent neighbours by a new symbol, again and
again until no pair is frequent enough to pay for its rule. In each round the most frequent
pairs that cannot overlap are taken, where no symbol is the left of one and the right of
another, so their counts hold while all are replaced at once. A run of one symbol is paired from its start.
The file keeps the rules, the length each symbol expands to, the rewritten ids, and where
documents start. Any range of ids is decoded by finding the symbols that cover it from these
lengths and expanding those alone.

A null or empty text has the end id alone. Null ids come first. Repeated rows are written as
often as they occur. Documents longer than a shard are cut and put together again when
their checksum is taken. An empty table gives a file with no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steward.llm.shared import Batches, batches_by_bytes, written
from steward.llm.tokens import PIECES_CHARS, encoder, ranges

SHARD_TOKENS, PART_BYTES = 1 << 19, 128 << 20
# A rule takes twelve bytes of the file and an occurrence saves four, so a pair pays from four times on.
LEAST_COUNT = 4


def _ordered(pairs: np.ndarray, places: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Both by pair, then by place, which has at most ``bits`` bits."""
    if int(pairs.max(initial=0)).bit_length() + bits > 63:
        order = np.lexsort((places, pairs))
        return pairs[order], places[order]
    both = np.sort(pairs << bits | places)
    return both >> bits, both & (1 << bits) - 1


def _overlapping(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of the places of pairs of two equal symbols, by pair and place, which are at odd places of their run."""
    runs = np.flatnonzero(np.append(True, after[places[:-1]] != places[1:]))
    return (np.arange(len(places)) - np.repeat(runs, np.diff(runs, append=len(places)))) % 2 == 1


def _apart(lefts: np.ndarray, rights: np.ndarray, symbols: int) -> np.ndarray:
    """Numbers of the pairs, in order, without those that could overlap with one before them.

    A pair of equal symbols is both the left and the right of itself, so it shares with no other.
    """
    is_left, is_right = bytearray(symbols), bytearray(symbols)
    left_of, right_of = np.frombuffer(is_left, np.bool_), np.frombuffer(is_right, np.bool_)
    taken: list[int] = []
    for at in range(0, len(lefts), 1024):
        a, b = lefts[at : at + 1024], rights[at : at + 1024]
        free = np.flatnonzero(~(right_of[a] | left_of[b]))
        for k, x, y in zip((at + free).tolist(), a[free].tolist(), b[free].tolist(), strict=True):
            if not (is_right[x] or is_left[y]):
                is_left[x] = is_right[y] = 1
                taken.append(k)
    return np.array(taken, dtype=np.int64)


def compress(ids: np.ndarray, end: int, first: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """(rules, symbols): rule k, a pair of symbols, is the meaning of symbol ``first + k``.

    It goes on until no pair occurs ``least`` times. Pairs with ``end`` are never taken, so no
    symbol reaches across documents. Each round takes one pair at least, the most frequent. Counts
    only fall, so after the first round a pair can be frequent only if it was before or holds a new
    symbol; only the places of those are looked at again. Symbols keep their places, linked to the next
    and the one before, so a round costs what it looks at.
    """
    least, n = max(least, 2), len(ids)
    wide, bits = (first + n // least).bit_length(), n.bit_length()
    low = (1 << wide) - 1
    now = np.append(ids, end).astype(np.int64 if wide > 31 else np.int32)
    after, before = np.minimum(np.arange(1, n + 2), n), np.arange(-1, n)
    rules: list[np.ndarray] = [np.zeros((0, 2), dtype=np.int64)]
    start, look = first, np.arange(n)
    while True:
        a, b = now[look], now[after[look]]
        inner = (a != end) & (b != end)
        pairs, places = _ordered(a[inner].astype(np.int64) << wide | b[inner], look[inner], bits)
        edges = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])[: len(pairs)])
        sizes, keys = np.diff(edges, append=len(pairs)), pairs[edges]
        lefts, rights, counts = keys >> wide, keys & low, sizes.copy()
        equal = np.flatnonzero((lefts == rights) & (sizes >= least))
        odd = ranges(edges[equal], sizes[equal])
        if len(odd):
            odd = odd[_overlapping(places[odd], after)]
            counts -= np.bincount(np.searchsorted(edges, odd, side="right") - 1, minlength=len(edges))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            symbols = now[:n]
            return np.concatenate(rules), symbols[symbols >= 0].astype(np.int64)
        often = often[np.argsort(-counts[often], kind="stable")]
        taken = often[_apart(lefts[often], rights[often], start)]
        rules.append(np.stack([lefts[taken], rights[taken]], axis=1))
        look_again = np.zeros(n + 1, dtype=bool)
        look_again[places[ranges(edges[often], sizes[often])]] = True
        hit = ranges(edges[taken], sizes[taken])
        made = np.repeat(np.arange(start, start + len(taken)), sizes[taken])
        if len(odd):
            even = ~np.isin(hit, odd)
            hit, made = hit[even], made[even]
        lead, made = _ordered(places[hit], made, wide)
        gone = after[lead]
        tail = after[gone]
        now[lead], now[gone] = made, -1
        after[lead], before[tail] = tail, lead
        start += len(taken)
        look_again[lead] = look_again[before[lead]] = True
        look_again[gone] = look_again[n] = False
        look = np.flatnonzero(look_again)


def lengths_of(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule's symbol expands to."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1))
    return np.array(out, dtype=np.int64)


@dataclass
class Shard:
    """One row of a file, ready to decode."""

    first: int
    rules: np.ndarray
    lengths: np.ndarray
    symbols: np.ndarray

    def __post_init__(self) -> None:
        self.ends = np.cumsum(self._sizes(self.symbols))

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each of ``symbols`` expands to."""
        nonterminal = symbols >= self.first
        sizes = np.ones(len(symbols), dtype=np.int64)
        sizes[nonterminal] = self.lengths[symbols[nonterminal] - self.first]
        return sizes

    @classmethod
    def read(cls, first: int, rules: bytes, lengths: bytes, symbols: bytes) -> Shard:
        pairs, sizes, now = (np.frombuffer(b, dtype="<u4").astype(np.int64) for b in (rules, lengths, symbols))
        return cls(first, pairs.reshape(-1, 2), sizes, now)

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """All symbols replaced by their pairs until only ids are left."""
        while len(at := np.flatnonzero(symbols >= self.first)):
            sizes = np.ones(len(symbols), dtype=np.int64)
            sizes[at] = 2
            pairs = self.rules[symbols[at] - self.first]
            starts = np.cumsum(sizes) - sizes
            out = np.repeat(symbols, sizes)
            out[starts[at]] = pairs[:, 0]
            out[starts[at] + 1] = pairs[:, 1]
            symbols = out
        return symbols

    def decode(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids at positions ``start`` to ``stop``; only the symbols that cover them are expanded, each once."""
        total = int(self.ends[-1]) if len(self.ends) else 0
        stop = total if stop is None else min(stop, total)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        i = int(np.searchsorted(self.ends, start, side="right"))
        j = int(np.searchsorted(self.ends, stop, side="left")) + 1
        before = int(self.ends[i - 1]) if i else 0
        symbols, ends = self.symbols[i:j], self.ends[i:j] - before
        used = np.zeros(self.first + len(self.rules), dtype=bool)
        used[symbols] = True
        distinct = np.flatnonzero(used)
        at = np.zeros(len(used), dtype=np.int64)
        at[distinct[1:]] = np.cumsum(self._sizes(distinct))[:-1]
        places = ranges(at[symbols], np.diff(ends, prepend=0))
        return self._expand(distinct).astype("<u4")[places[start - before : stop - before]]


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end: int,
    id_: str = "doc_id",
    text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> None:
    """Encode and write ``docs`` to Parquet files at ``path``, one row per shard.

    Columns: ``part`` and ``shard`` give the order; ``keys``, ``rows``, ``starts`` and ``whole``
    hold for each document its id, a number of its own, where it starts in the shard, and whether
    all of it is there; ``first``, ``rules``, ``lengths``, ``symbols`` are the grammar, and
    ``n_tokens`` counts the ids.
    """
    kind = docs.schema[id_].dataType.simpleString()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = max(least, -(-size // PART_BYTES))
    key = F.col(id_).asc_nulls_first()
    tie = F.monotonically_increasing_id().alias("_tie")
    narrow = docs.select(id_, F.col(text).alias("_text"), tie)
    ordered = narrow.repartitionByRange(parts, key, "_tie").sortWithinPartitions(key, "_tie")
    names = ["part", "shard", "keys", "rows", "starts", "whole", "n_tokens", "first", "rules", "lengths", "symbols"]

    def step(batches: Batches) -> Batches:
        library = encoder(tokenizer)
        first = max(library.size, end + 1)
        part, number = TaskContext.get().partitionId(), 0
        keys: list = []
        rows: list[int] = []
        starts: list[int] = []
        whole: list[bool] = []
        held: list[np.ndarray] = []
        size = done = 0
        arrow = None

        def close() -> pa.RecordBatch:
            nonlocal size, number
            rules, symbols = compress(np.concatenate(held), end, first)
            grammar = [rules.astype("<u4"), lengths_of(rules, first).astype("<u4"), symbols.astype("<u4")]
            values = [part, number, keys, rows, starts, whole, size, first, *(g.tobytes() for g in grammar)]
            long = pa.int64()
            kinds = [long, long, *(pa.list_(k) for k in (arrow, long, long, pa.bool_())), long, long]
            kinds += [pa.binary()] * 3
            out = [pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            for filled in (keys, rows, starts, whole, held):
                filled.clear()
            size, number = 0, number + 1
            return pa.RecordBatch.from_arrays(out, names)

        for all_rows in batches:
            for batch in batches_by_bytes(all_rows, 1, PIECES_CHARS):
                arrow = batch.schema.field(0).type
                found = library.encode(batch.column(1).to_pylist())
                for key, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                    ids = np.append(ids, np.uint32(end))
                    row = part << 40 | done
                    done += 1
                    at = 0
                    while at < len(ids):
                        piece = ids[at : at + shard_tokens - size]
                        keys.append(key)
                        rows.append(row)
                        starts.append(size)
                        whole.append(len(piece) == len(ids))
                        held.append(piece)
                        size += len(piece)
                        at += len(piece)
                        if size == shard_tokens:
                            yield close()
        if size:
            yield close()

    schema = (
        f"part bigint, shard bigint, keys array<{kind}>, rows array<bigint>, starts array<bigint>, "
        "whole array<boolean>, n_tokens bigint, first bigint, rules binary, lengths binary, symbols binary"
    )
    ordered.mapInArrow(step, schema).write.parquet(path)


def _shift(crc: int, length: int) -> int:
    """The checksum ``crc`` moved on by ``length`` zero bytes: squares of the matrix of one zero bit."""

    def times(matrix: list[int], vector: int) -> int:
        total = 0
        for row in matrix:
            if vector & 1:
                total ^= row
            vector >>= 1
        return total

    matrix = [0xEDB88320, *(1 << k for k in range(31))]
    for _ in range(3):
        matrix = [times(matrix, m) for m in matrix]
    while length:
        if length & 1:
            crc = times(matrix, crc)
        matrix = [times(matrix, m) for m in matrix]
        length >>= 1
    return crc


def joined_crc32(pieces: Iterable[tuple[int, int]]) -> int:
    """The checksum of bytes whose consecutive pieces have these (checksum, length)."""
    total = 0
    for crc, length in pieces:
        total = _shift(total, length) ^ crc
    return total


def offsets(files: DataFrame) -> DataFrame:
    """(part, shard, base): ids in all shards before. Sums run per part, then over parts."""
    sizes = files.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("at"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    run = sizes.withColumn("in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return run.join(parts, "part").select("part", "shard", (F.col("at") + F.col("in")).alias("base"))


def read(spark: SparkSession, path: str, id_: str = "doc_id") -> DataFrame:
    """Per document of the files: id, ``start`` among all ids, ``n_tokens``, ``ids_crc32``."""
    files = spark.read.parquet(path)
    kind = files.schema["keys"].dataType.elementType.simpleString()
    names = [id_, "row", "part", "shard", "at", "n", "crc", "whole"]

    def step(batches: Batches) -> Batches:
        for batch in batches:
            key = batch.schema.field("keys").type.value_type
            for r in batch.to_pylist():
                ids = Shard.read(r["first"], r["rules"], r["lengths"], r["symbols"]).decode()
                cuts = [*r["starts"], len(ids)]
                n = len(r["keys"])
                crcs = [crc32(ids[cuts[k] : cuts[k + 1]].tobytes()) for k in range(n)]
                places = [r["rows"], [r["part"]] * n, [r["shard"]] * n, r["starts"], np.diff(cuts), crcs]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["keys"], key), *(pa.array(p, pa.int64()) for p in places), pa.array(r["whole"])],
                    names,
                )

    def join(batches: Batches) -> Batches:
        for batch in batches:
            crcs = [joined_crc32((p["crc"], 4 * p["n"]) for p in row) for row in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(crcs, pa.int64())], [id_, "start", "n_tokens", "ids_crc32"]
            )

    schema = (
        f"`{id_}` {kind}, row bigint, part bigint, shard bigint, at bigint, n bigint, crc bigint, whole boolean"
    )
    pieces = written(files.mapInArrow(step, schema), "decoded")
    placed = pieces.join(offsets(files), ["part", "shard"]).withColumn("start", F.col("base") + F.col("at"))
    whole = placed.filter("whole").select(id_, "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = placed.filter("not whole").groupBy("row").agg(
        F.first(id_).alias(id_),
        F.min("start").alias("start"),
        F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("start", "n", "crc"))).alias("pieces"),
    )
    joined = cut.select(id_, "start", "n_tokens", "pieces").mapInArrow(
        join, f"`{id_}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return whole.unionByName(joined)
