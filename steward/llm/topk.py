"""Exact top-k search by inner product, with multi-resolution segment statistics.

A vector is cut into segments, and each segment is described by its mean and deviation. By
Cauchy's inequality they bound the distance of two vectors from below, which for known lengths
is to bound their product from above. Bounds are taken with few long segments first, then
with more short ones; a candidate whose bound is below a query's k-th best product so far is
dropped, and the product of what survives is computed exactly.

Queries and candidates are packed into blocks. Every block of queries meets every slice of
candidate blocks in one group, by an equality of block numbers; a query's best of all slices are
merged at the end. So no row is paired with a row outside tasks, and a group is bounded.

Components are ``floor(scale * x)`` with x as a double. Vectors that are null or hold null or
non-finite components take no part; shorter vectors count as filled up with zeros. A row with
the query's id is no candidate for it. A null id ranks as the largest. Repeated query rows
have a ranking each. Scores must fit 64 bits, or the search fails.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from steward.llm.shared import Batches, written

SCALE = 1024
LEVELS = (16, 4)  # components per segment, coarse to fine
BLOCK, SLICE, QUERY_BLOCK = 1024, 8, 2048  # candidates in a block, blocks in a slice, queries in a block
_NULL = 2**63 - 1


def _usable(vec: str):
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vec).isNotNull() & finite


def _blocks(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows (id, vec) packed: (n, dim, ids, cells) with integers as 64-bit floats, exact below 2**53."""

    def step(batches: Batches) -> Batches:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                vectors = [np.floor(scale * np.array(v, dtype=np.float64)) for v in part.column(1).to_pylist()]
                dim = -(-max(1, max(map(len, vectors))) // LEVELS[0]) * LEVELS[0]
                cells = np.zeros((len(vectors), dim))
                for k, v in enumerate(vectors):
                    cells[k, : len(v)] = v
                ids = [_NULL if i is None else i for i in part.column(0).to_pylist()]
                values = [[len(ids)], [dim], [np.array(ids, dtype=np.int64).tobytes()], [cells.tobytes()]]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["n", "dim", "ids", "cells"]
                )

    return rows.mapInArrow(step, "n bigint, dim bigint, ids binary, cells binary")


def _numbered(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks written once with dense numbers ``b``; a window over one row per task gives the offsets."""
    stored = written(blocks.withColumn("row", F.monotonically_increasing_id()), name)
    task = F.shiftright("row", 33)
    counts = stored.groupBy(task.alias("task")).agg(F.count("*").alias("k"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    dense = F.col("base") + F.col("row").bitwiseAND((1 << 33) - 1)
    return stored.withColumn("task", task).join(bases, "task").select(dense.alias("b"), "n", "dim", "ids", "cells")


def _unpack(n: int, dim: int, ids: bytes, cells: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((n, width))
    out[:, :dim] = np.frombuffer(cells).reshape(n, dim)
    return np.frombuffer(ids, dtype=np.int64), out


def _statistics(cells: np.ndarray, length: int) -> np.ndarray:
    """Means and deviations of segments, scaled so that a dot product bounds that of the vectors."""
    parts = cells.reshape(len(cells), -1, length)
    root = np.sqrt(length)
    return np.concatenate([parts.mean(axis=2) * root, parts.std(axis=2) * root], axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of integer rows."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a.tolist()], dtype=object)
    other = np.array([[int(x) for x in r] for r in b.tolist()], dtype=object)
    return (exact @ other.T).astype(np.int64)  # raises beyond 64 bits


def _search(queries: tuple, blocks: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """(query row, id, score) of the k best in ``blocks`` for every query, ties to the smaller id."""
    own, q = queries
    stats = [_statistics(q, length) for length in LEVELS]
    norms = np.linalg.norm(q, axis=1)
    least = np.full(len(q), -np.inf)  # a query's k-th best so far
    best = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    for ids, c in blocks:
        alive = np.ones((len(q), len(c)), dtype=bool)
        slack = 1e-9 * (norms[:, None] * np.linalg.norm(c, axis=1)[None, :]) + 1e-6
        for mine, length in zip(stats, LEVELS, strict=True):
            bound = mine @ _statistics(c, length).T + slack
            alive &= bound >= least[:, None]
            if not alive.any():
                break
        rows, cols = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(rows):
            continue
        exact = _products(q[rows], c[cols])
        open_ = alive[np.ix_(rows, cols)] & (own[rows, None] != ids[None, cols]) & (exact >= least[rows, None])
        if exact.shape[1] > k:  # below the block's own k-th best nothing can rank
            masked = np.where(open_, exact, np.iinfo(np.int64).min)
            open_ &= exact >= np.partition(masked, -k, axis=1)[:, -k, None]
        i, j = np.nonzero(open_)
        found = (rows[i], ids[cols[j]], exact[i, j])
        row, id_, score = (np.concatenate(x) for x in zip(best, found, strict=True))
        order = np.lexsort((id_, -score, row))
        row, id_, score = row[order], id_[order], score[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        top = rank < k
        best = (row[top], id_[top], score[top])
        last = rank == k - 1
        least[row[last]] = score[last]
    return best


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 10, id_: str = "vec_id", vec: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` candidates with the highest product for each query."""
    asked, rows = (
        df.select(F.col(id_).cast("bigint").alias("id"), F.col(vec).alias("vec")).filter(_usable("vec"))
        for df in (queries, candidates)
    )
    q = _numbered(_blocks(asked, QUERY_BLOCK, scale), "queries")
    c = _numbered(_blocks(rows, BLOCK, scale), "candidates")
    n_queries, n_blocks = (written(df, "blocks").count() for df in (q.select("b"), c.select("b")))
    slices = max(1, -(-n_blocks // SLICE))
    left = q.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = c.withColumn("s", F.floor(F.col("b") / SLICE).cast("int")).withColumnRenamed("b", "own")
    numbers = F.sequence(F.lit(0).cast("bigint"), F.lit(max(0, n_queries - 1)).cast("bigint"))
    right = right.withColumn("b", F.explode(numbers))

    def step(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        rows, blocks = mine.to_pylist(), theirs.sort_by("own").to_pylist()
        out = [np.zeros(0, dtype=np.int64)] * 4
        if rows and blocks:
            width = max(r["dim"] for r in rows + blocks)
            own, cells = _unpack(rows[0]["n"], rows[0]["dim"], rows[0]["ids"], rows[0]["cells"], width)
            others = [_unpack(r["n"], r["dim"], r["ids"], r["cells"], width) for r in blocks]
            row, ids, score = _search((own, cells), others, k)
            out = [row + rows[0]["b"] * QUERY_BLOCK, own[row], ids, score]
        return pa.table([pa.array(o) for o in out], names=["row", "query_id", id_, "score"])

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(
        step, f"row bigint, query_id bigint, `{id_}` bigint, score bigint"
    )
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc(id_))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    known = F.when(F.col(id_) != _NULL, F.col(id_))
    asked_id = F.when(F.col("query_id") != _NULL, F.col("query_id"))
    return ranked.select(asked_id.alias("query_id"), "rank", known.alias(id_), "score")
