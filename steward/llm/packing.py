"""Packing of token ids into sequences of one length, balanced by cost.

A sequence's cost is what attention over its pieces takes: linear plus quadratic in the
length of each piece. Documents, longest first, go to the sequence of lowest cost that has
room for them. Where none has, the document is cut: it fills the cheapest open sequence and
goes on in the next. So a block of documents fills exactly as many sequences as it needs and
leaves less than one sequence of padding.

Packing runs where the documents are read, block by block, with no shuffle: a block is
closed once it holds ``BLOCK`` sequences' worth of tokens, so a task holds one block at a
time. Of a document longer than a sequence, whole sequences are cut off first.

A null text counts as empty and has the end id alone. Rows are packed one by one, so repeated
rows are packed as often as they occur; a null id stays null. Sequence numbers derive from
the partition and the place in it: they are unique, equal when a task is run again, and leave gaps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.llm.shared import Batches, batches_of
from steward.llm.tokens import encoder

LENGTH = 1024
BLOCK = 512  # sequences
LINEAR, QUADRATIC = 1.0, 1.0 / LENGTH  # at a full sequence both cost the same


def cost(length: np.ndarray | int, linear: float = LINEAR, quadratic: float = QUADRATIC):
    """Estimated work of attention over one piece."""
    return linear * length + quadratic * length * length


def balance(
    lengths: list[int], size: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC
) -> Iterator[tuple[int, int, int, int, int]]:
    """Place documents of these lengths, each below ``size``, in as few sequences as hold them.

    Yields (document, start in it, length, sequence, offset in the sequence). Ties go to the
    earlier document and the earlier sequence.
    """
    n = -(-sum(lengths) // size)
    costs, room = np.zeros(n), np.full(n, size, dtype=np.int64)
    for doc in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start, left = 0, lengths[doc]
        while left:
            fits = room >= left
            if fits.any():
                to, part = int(np.argmin(np.where(fits, costs, np.inf))), left
            else:
                to = int(np.argmin(np.where(room > 0, costs, np.inf)))
                part = int(room[to])
            yield doc, start, part, to, size - int(room[to])
            costs[to] += cost(part, linear, quadratic)
            room[to] -= part
            start, left = start + part, left - part


def pack(
    docs: DataFrame,
    tokenizer: str,
    end: int,
    id_: str = "doc_id",
    text: str = "text",
    size: int = LENGTH,
    block: int = BLOCK,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """Per piece: the id, ``start`` and ``length`` in the document, ``doc_tokens``, ``sequence_id``,
    ``offset``, and ``ids``, the token ids as little-endian unsigned 32-bit integers."""
    kind = docs.schema[id_].dataType
    schema = (
        f"`{id_}` {kind.simpleString()}, start bigint, length bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, ids binary"
    )
    names = [id_, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

    def step(batches: Batches) -> Batches:
        encode = encoder(tokenizer).encode
        first = TaskContext.get().partitionId() << 40
        arrow = None
        rows: list[tuple] = []
        waiting: list[tuple] = []  # id, ids, start of the rest
        held = 0

        def close() -> None:
            nonlocal first, held
            lengths = [len(ids) - start for _, ids, start in waiting]
            for doc, at, part, to, offset in balance(lengths, size, linear, quadratic):
                key, ids, start = waiting[doc]
                piece = ids[start + at : start + at + part].tobytes()
                rows.append((key, start + at, part, len(ids), first + to, offset, piece))
            first += -(-sum(lengths) // size)
            waiting.clear()
            held = 0

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [arrow, *[pa.int64()] * 5, pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for whole in batches:
            arrow = whole.schema.field(0).type
            for batch in batches_of(whole, 256):
                keys = batch.column(0).to_pylist()
                for key, ids in zip(keys, encode(batch.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    cut = len(ids) // size * size
                    for at in range(0, cut, size):
                        piece = ids[at : at + size].tobytes()
                        rows.append((key, at, size, len(ids), first, 0, piece))
                        first += 1
                    if cut < len(ids):
                        waiting.append((key, ids, cut))
                        held += len(ids) - cut
                    if held >= block * size:
                        close()
                if rows:
                    yield out()
        if waiting:
            close()
            yield out()

    return docs.select(id_, F.col(text).alias("_text")).mapInArrow(step, schema)
