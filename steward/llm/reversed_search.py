"""Ranked lexical search turned round: the documents stream through an index of the items.

Items are the queries and few, documents are many. So the inverted index is built over the
items' terms, sent to every task, and each document's term counts are streamed through it.
A task keeps, per item, a heap of the best documents it has met; heaps are merged by item.
Nothing is shuffled but counts of the index's terms and heaps.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, with A-Z
lower-cased. With N documents that hold a term, L terms in all of them, n terms in one
document, df documents that hold a term and tf its occurrences in a document, its score is the
sum over an item's terms, repeats included, of ``w * ((1000000000 * tf) div (1000 * tf + 12 * m))``
where ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and ``m = 75 + (25 * n * N) div L``.

Items whose index outgrows ``block_bytes`` are dealt into blocks, each with an index of
its own and a pass over the documents, so what a task is sent stays bounded.

Defined results. Null and empty texts hold no term: such an item has no rows, such a
document counts nowhere. Very long texts are counted whole, one at a time. Equal scores
rank by document id, a null id last; rows of one id are ranked each by itself, and so are items of one
id or none, which give one ranking per row. Empty tables give no rows. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from steward.llm.shared import Batches, mapped, written

# Fixed value: what separates terms. In UTF-8 all bytes of characters beyond ASCII are above these.
TERM = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

# An index in memory takes about so many bytes per entry, beside its terms.
ENTRY_BYTES = 64
BLOCK_BYTES = 32 << 20

# Scores of so many (document, item) pairs are held at once.
CELLS = 1 << 20

# Heaps meet in so many groups per item before the last merge.
FIRST_MERGES = 64

_BEST = "item bigint, score bigint, doc_id bigint, bin int"


def terms(text: bytes | None) -> Counter[bytes]:
    """How often each term of a text in UTF-8 occurs; ``lower`` on bytes changes A-Z alone."""
    return Counter(TERM.findall(text.lower())) if text else Counter()


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class Index:
    """Which items hold a term, and how often: term number k has entries ``at[k]`` to ``at[k + 1]``."""

    def __init__(self, rows: list[tuple[int, bytes, int]]):
        self.items = sorted({r[0] for r in rows})
        place = {item: k for k, item in enumerate(self.items)}
        names = sorted({r[1] for r in rows})
        self.number = {name: k for k, name in enumerate(names)}
        entries = sorted((self.number[term], place[item], n) for item, term, n in rows)
        of_term, self.item, self.times = np.array(entries, dtype=np.int64).reshape(-1, 3).T.copy()
        self.at = np.searchsorted(of_term, np.arange(len(names) + 1))


def _entries(items: DataFrame) -> DataFrame:
    """One row per item row and term; items are told apart by a number of their own."""

    def step(batches: Batches) -> Batches:
        for batch in batches:
            rows = [
                (item, term, n)
                for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True)
                for term, n in terms(text).items()
            ]
            item, term, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, pa.int64()), pa.array(term, pa.binary()), pa.array(n, pa.int64())], ["item", "term", "n"]
            )

    return mapped(items.select("item", F.col("text").cast("binary").alias("text")), step, "item bigint, term binary, n bigint")


def _counts(postings: DataFrame) -> DataFrame:
    """Documents per term number; -1 stands for all documents with a term, -2 for all their terms."""

    def step(batches: Batches) -> Batches:
        seen: Counter[int] = Counter()
        for batch in batches:
            held = [np.frombuffer(b, "<i4") for b in batch["terms"].to_pylist()]
            if held:
                number, n = np.unique(np.concatenate(held), return_counts=True)
                seen.update(dict(zip(number.tolist(), n.tolist(), strict=True)))
            seen[-1] += batch.num_rows
            seen[-2] += sum(batch["n"].to_pylist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["term", "n"]
        )

    return mapped(postings, step, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def _postings(documents: DataFrame, number: dict[bytes, int], id_column: str, text_column: str) -> DataFrame:
    """Per document with a term: its id, how many terms it has, and its counts of the index's terms."""
    sent = documents.sparkSession.sparkContext.broadcast(number)

    def step(batches: Batches) -> Batches:
        known = sent.value
        for batch in batches:
            ids, ns, held, counts = [], [], [], []
            for k in range(batch.num_rows):
                found = terms(batch["text"][k].as_py())
                if found:
                    hit = [(known[t], n) for t, n in found.items() if t in known]
                    pairs = np.array(hit, dtype="<i4").reshape(-1, 2)
                    ids.append(batch["id"][k].as_py())
                    ns.append(found.total())
                    held.append(pairs[:, 0].tobytes())
                    counts.append(pairs[:, 1].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(held, pa.binary()), pa.array(counts, pa.binary())],
                ["doc_id", "n", "terms", "counts"],
            )

    columns = F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("binary").alias("text")
    return mapped(documents.select(*columns), step, "doc_id bigint, n bigint, terms binary, counts binary")


class Heaps:
    """The best ``k`` rows (score, id) per item; of equal scores those of smaller id."""

    NONE = 1 << 63  # a null id comes after all others

    def __init__(self, items: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, dtype=np.int64)

    def push(self, scores: np.ndarray, ids: list[int | None]) -> None:
        """``scores`` has a row per document and a column per item; 0 is no match."""
        for item in np.flatnonzero((scores > 0).any(axis=0) & (scores.max(axis=0, initial=0) >= self.least)).tolist():
            column = scores[:, item]
            at = np.flatnonzero((column > 0) & (column >= self.least[item])).tolist()
            new = [(-int(column[d]), self.NONE if ids[d] is None else ids[d]) for d in at]
            best = sorted(self.rows[item] + new)[: self.k]
            self.rows[item] = best
            if len(best) == self.k:
                self.least[item] = -best[-1][0]

    def out(self) -> Iterator[tuple[int, int, int | None]]:
        for item, best in enumerate(self.rows):
            for score, i in best:
                yield item, -score, None if i == self.NONE else i


def scores_of(index: Index, weights: np.ndarray, m: list[int], held: list[np.ndarray], counts: list[np.ndarray]) -> np.ndarray:
    """Scores of some documents for all items, in whole numbers."""
    out = np.zeros(len(held) * len(index.items), dtype=np.int64)
    if not len(out):
        return out.reshape(len(held), -1)
    doc = np.repeat(np.arange(len(held)), [len(h) for h in held])
    term, tf = np.concatenate(held).astype(np.int64), np.concatenate(counts).astype(np.int64)
    value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.array(m, dtype=np.int64)[doc]))
    first, size = index.at[term], index.at[term + 1] - index.at[term]
    entry = np.arange(size.sum()) + np.repeat(first - np.cumsum(size) + size, size)
    cell = np.repeat(doc * len(index.items), size) + index.item[entry]
    np.add.at(out, cell, np.repeat(value, size) * index.times[entry])
    return out.reshape(len(held), -1)


def _best(postings: DataFrame, index: Index, counts: dict[int, int], k: int) -> DataFrame:
    documents, total = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([weight(documents, counts.get(t, 0)) for t in range(len(index.number))], dtype=np.int64)
    sent = postings.sparkSession.sparkContext.broadcast((index, weights))

    def step(batches: Batches) -> Batches:
        index, weights = sent.value
        heaps = Heaps(len(index.items), k)
        rows = max(1, CELLS // max(1, len(index.items)))
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                m = [75 + 25 * n * documents // total for n in part["n"].to_pylist()]
                held = [np.frombuffer(b, "<i4") for b in part["terms"].to_pylist()]
                tf = [np.frombuffer(b, "<i4") for b in part["counts"].to_pylist()]
                heaps.push(scores_of(index, weights, m, held, tf), part["doc_id"].to_pylist())
        found = list(heaps.out())
        place = TaskContext.get().partitionId() % FIRST_MERGES
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([index.items[f[0]] for f in found], pa.int64()),
                pa.array([f[1] for f in found], pa.int64()),
                pa.array([f[2] for f in found], pa.int64()),
                pa.array([place] * len(found), pa.int32()),
            ],
            ["item", "score", "doc_id", "bin"],
        )

    return mapped(postings.select("doc_id", "n", "terms", "counts"), step, _BEST)


def _merged(heaps: DataFrame, k: int) -> DataFrame:
    """Heaps of an item are merged in groups first, so that no task takes in one per task."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for group in (["item", "bin"], ["item"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        heaps = heaps.withColumn("rank", rank).filter(F.col("rank") <= k)
    return heaps


def search(
    items: DataFrame,
    documents: DataFrame,
    k: int = 20,
    item_id: str = "item_id",
    doc_id: str = "doc_id",
    text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank from 1, doc_id, score.

    Ids are whole numbers. Only documents that share a term with an item have a score.
    """
    spark = items.sparkSession
    numbered = written(
        items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(text).alias("text")),
        "items",
    )
    entries = written(_entries(numbered), "items-terms")
    size = entries.agg(F.sum(F.octet_length("term") + ENTRY_BYTES)).first()[0] or 0
    blocks = -(-size // block_bytes)
    found = spark.createDataFrame([], "item bigint, score bigint, doc_id bigint, bin int, rank int")
    parts = []
    for block in range(blocks):
        mine = F.pmod(F.xxhash64("item"), F.lit(blocks)) == block
        rows = [(r.item, bytes(r.term), r.n) for r in entries.filter(mine).toLocalIterator()]
        if not rows:
            continue
        index = Index(rows)
        postings = written(_postings(documents, index.number, doc_id, text), "postings")
        counts = {r.term: r.n for r in _counts(postings).collect()}
        if counts.get(-1):
            parts.append(written(_merged(_best(postings, index, counts, k), k), "best"))
    found = reduce(DataFrame.unionByName, parts, found)
    return found.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
