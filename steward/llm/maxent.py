"""Language-model scores of documents by a hashed maximum-entropy model.

A token is a word, with A-Z lower-cased, or the end of its document. Whole words are hashed to
1,024 symbols; symbols are dealt by falling frequency into 32 classes of 32. A token has the probability

    P(class | history) * P(symbol | class, history) * P(word | symbol)

where the first two are softmaxes over sums of weight rows, and the last is a smoothed
share: ``(c + 1) / (n + v + 1)`` with c the word's count, and n tokens and v words of
that symbol, all in the training documents. One share is left for words never seen, so the
probabilities of all words sum to one after any history. The weight rows are picked by hashed features of the
history: the symbol before, and, skipping the rarer ones, the last two frequent symbols as a pair.

Counting and training cover all training documents. Texts are read once and stored as
blocks of codes with a dictionary each. Words and their counts meet by a hash of the word, in parts
of bounded size; sums return to the blocks, not to the driver. Training deals the blocks
into rounds. In a round every task takes gradient steps from the round's weights over
its blocks; the weighted means of what the tasks added, row by row, make the next
weights. The model's size is fixed by ``CLASSES``, ``PLACES`` and the table sizes: 3 MB.

Defined results. A null text is empty: it has one token, its end. Rows without id teach and are not held
out. Very long texts stay whole in one block. Repeated rows are scored and counted each. With no
training documents all counts are zero. An empty table gives no rows. Columns but id and text are
not read, so they may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from steward.llm.shared import Batches, mapped, written
from steward.session import scratch_path

END = b"\n"  # no word holds white space

CLASSES = PLACES = 32
SYMBOLS = CLASSES * PLACES
START = SYMBOLS - 1  # before a document; shares its rows with the rarest symbol

# Symbols of the first ranks are frequent: such words tell the language and the manner of a text.
FREQUENT = 255

# Rows of the features. For the class: the symbol before, and the last two frequent ones as a pair.
# For the place in a class: the class with the symbol before, and with the last frequent one.
PAIRS = NEAR = SKIP = 8192
CLASS_ROWS = SYMBOLS + PAIRS
ROWS = CLASS_ROWS + NEAR + SKIP

ONES = np.ones(CLASSES, dtype=np.float32)  # a product sums short rows faster than a reduction

# About so many bytes of text make a block, and so many bytes of words a part.
BLOCK_BYTES = 16 << 20
PART_BYTES = 8 << 20

ROUNDS = 3
STEP_TOKENS = 8192
RATE = 0.15
# A task trains on at least so many tokens, so that its additions are few beside its input.
TASK_TOKENS = 2 << 20

_BLOCKS = (
    "block bigint, slice int, ids array<bigint>, held array<boolean>, lengths array<bigint>, codes binary, "
    "symbols binary, words array<binary>, counts binary, word_bytes bigint, tokens bigint"
)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# --- texts to blocks ------------------------------------------------------------------


class Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def symbol_of(word: bytes) -> int:
    return crc32(word) % SYMBOLS


class Block:
    """Documents as codes of a dictionary of their own."""

    def __init__(self):
        self.codes = Codes({END: 0})
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.tokens: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, held: bool, text: bytes | None) -> None:
        found = text.lower().split() if text else []  # on bytes: A-Z alone, and white space of ASCII alone
        found.append(END)
        self.tokens.append(np.fromiter(map(self.codes.__getitem__, found), dtype="<u4", count=len(found)))
        self.ids.append(doc_id)
        self.held.append(held)
        self.bytes += len(text or b"")

    def row(self, number: int, rounds: int) -> pa.RecordBatch:
        taught = [t for t, h in zip(self.tokens, self.held, strict=True) if not h]
        counts = np.bincount(np.concatenate(taught), minlength=len(self.codes)) if taught else np.zeros(len(self.codes))
        words, lengths = list(self.codes), [len(t) for t in self.tokens]
        symbols = np.array([symbol_of(w) for w in words], dtype="<u2")
        values = [
            pa.array([number]),
            pa.array([crc32(number.to_bytes(8, "little")) % rounds], pa.int32()),
            _listed(pa.array(self.ids, pa.int64())),
            _listed(pa.array(self.held, pa.bool_())),
            _listed(pa.array(lengths, pa.int64())),
            pa.array([np.concatenate(self.tokens).tobytes()], pa.binary()),
            pa.array([symbols.tobytes()], pa.binary()),
            _listed(pa.array(words, pa.binary())),
            pa.array([counts.astype("<i8").tobytes()], pa.binary()),
            pa.array([sum(map(len, words)) + 16 * len(words)]),
            pa.array([sum(lengths)]),
        ]
        return pa.RecordBatch.from_arrays(values, [part.split()[0] for part in _BLOCKS.split(", ")])


def _listed(values: pa.Array) -> pa.ListArray:
    """One list of all values."""
    return pa.ListArray.from_arrays([0, len(values)], values)


def _blocks(documents: DataFrame, doc_id: str, text: str, held: Column, rounds: int, block_bytes: int) -> DataFrame:
    def step(batches: Batches) -> Batches:
        first = TaskContext.get().partitionId() << 32
        block, number = Block(), 0
        for batch in batches:
            for k in range(batch.num_rows):
                block.add(batch["id"][k].as_py(), batch["held"][k].as_py(), batch["text"][k].as_py())
                if block.bytes >= block_bytes:
                    yield block.row(first + number, rounds)
                    block, number = Block(), number + 1
        if block.ids:
            yield block.row(first + number, rounds)

    asked = documents.select(F.col(doc_id).cast("bigint").alias("id"), held.alias("held"), F.col(text).cast("binary").alias("text"))
    made = mapped(asked, step, _BLOCKS)
    path = scratch_path(documents.sparkSession, "blocks")
    made.write.partitionBy("slice").option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    return documents.sparkSession.read.schema(made.schema).parquet(path)


# --- counts of words ------------------------------------------------------------------


def _dealt(blocks: DataFrame, parts: int) -> DataFrame:
    """The words of each block by part; a word's part follows from the word alone."""

    def step(batches: Batches) -> Batches:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.frombuffer(row["counts"], "<i8")
                part = np.array([crc32(w) // SYMBOLS % parts for w in row["words"]], dtype=np.int64)
                order = np.argsort(part, kind="stable")
                for mine in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["block"]], pa.int64()),
                            pa.array([part[mine[0]]], pa.int64()),
                            pa.array([mine.astype("<u4").tobytes()], pa.binary()),
                            pa.array([[row["words"][k] for k in mine]], pa.list_(pa.binary())),
                            pa.array([counts[mine].tobytes()], pa.binary()),
                        ],
                        ["block", "part", "codes", "words", "counts"],
                    )

    return mapped(
        blocks.select("block", "words", "counts"), step, "block bigint, part bigint, codes binary, words array<binary>, counts binary"
    )


def _summed(key: tuple, group: pa.Table) -> pa.Table:
    """Sums over all blocks of a part's words: a row per block, and one of sums by symbol without block."""
    words = group["words"].to_pylist()
    counts = [np.frombuffer(c, "<i8").tolist() for c in group["counts"].to_pylist()]
    total: Counter[bytes] = Counter()
    for some, n in zip(words, counts, strict=True):
        for word, count in zip(some, n, strict=True):
            total[word] += count
    sums = [np.array([total[w] for w in some], dtype="<i8").tobytes() for some in words]
    known = [(symbol_of(w), n) for w, n in total.items() if n]
    by_symbol = np.zeros((2, SYMBOLS), dtype="<i8")
    if known:
        symbol, n = np.array(known).T
        np.add.at(by_symbol[0], symbol, n)
        np.add.at(by_symbol[1], symbol, 1)
    return pa.table(
        [
            pa.array([*group["block"].to_pylist(), None], pa.int64()),
            pa.array([*group["codes"].to_pylist(), None], pa.binary()),
            pa.array([*sums, by_symbol.tobytes()], pa.binary()),
        ],
        ["block", "codes", "sums"],
    )


def _symbol_sums(counted: DataFrame) -> np.ndarray:
    """Tokens and words per symbol; tasks add theirs up first."""

    def step(batches: Batches) -> Batches:
        total = np.zeros((2, SYMBOLS), dtype=np.int64)
        for batch in batches:
            for sums in batch["sums"].to_pylist():
                total += np.frombuffer(sums, "<i8").reshape(2, -1)
        symbol = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays([pa.array(symbol, pa.int64()), pa.array(total[0, symbol]), pa.array(total[1, symbol])], ["symbol", "n", "v"])

    rows = mapped(counted.filter("block IS NULL").select("sums"), step, "symbol bigint, n bigint, v bigint")
    out = np.zeros((2, SYMBOLS), dtype=np.int64)
    for r in rows.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        out[:, r.symbol] = r.n, r.v
    return out


# --- the model ------------------------------------------------------------------------


def _mix(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """Two numbers hashed to ``size`` rows."""
    mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed * np.uint64(0x165667B19E3779F9)) >> np.uint64(40)).astype(np.int64) % size


def history(ranks: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """What each token's features rest on: the symbol before it, and, skipping rarer ones, the last two frequent ones."""
    place = np.arange(len(ranks))
    first = np.repeat(np.cumsum(lengths) - lengths, lengths)
    near = np.full(len(ranks), START, dtype=np.int64)
    near[1:] = ranks[:-1]
    near[place == first] = START
    last = np.full(len(ranks), -1, dtype=np.int64)
    last[1:] = np.maximum.accumulate(np.where(ranks < FREQUENT, place, -1))[:-1]
    out = [near]
    for _ in range(2):
        there = last >= first
        out.append(np.where(there, ranks[last], FREQUENT))
        last = np.where(there, last[last], -1)
    return out


def class_rows(before: list[np.ndarray]) -> list[np.ndarray]:
    near, last, other = before
    return [near, SYMBOLS + _mix(last, other, PAIRS)]


def place_rows(before: list[np.ndarray], classes: np.ndarray) -> list[np.ndarray]:
    near, last, _ = before
    return [CLASS_ROWS + _mix(near, classes + 1, NEAR), CLASS_ROWS + NEAR + _mix(last, classes + 1, SKIP)]


class Model:
    """Weights, and priors from the frequencies of symbols."""

    def __init__(self, sums: np.ndarray):
        n, v = sums
        self.order = np.argsort(-n, kind="stable")
        self.rank = np.empty(SYMBOLS, dtype=np.int64)
        self.rank[self.order] = np.arange(SYMBOLS)
        ranked = n[self.order].reshape(CLASSES, PLACES)
        in_class = ranked.sum(axis=1)
        self.class_prior = np.log((in_class + 1) / (in_class.sum() + CLASSES)).astype(np.float32)
        self.place_prior = np.log((ranked + 1) / (in_class[:, None] + PLACES)).astype(np.float32)
        self.tokens, self.words = int(n.sum()), int(v.sum())
        self.shares = np.log10(n + v + 1.0)  # what a word's count is divided by, per symbol
        self.weights = np.zeros((ROWS, CLASSES), dtype=np.float32)

    def logits(self, weights: np.ndarray, rows: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
        out = weights.take(rows[0], axis=0)
        out += prior
        for more in rows[1:]:
            out += weights.take(more, axis=0)
        return out

    def log_probability(self, ranks: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(symbol | history) per token; ``ranks`` are symbols by falling frequency."""
        out = []
        for part, before in _steps(ranks, lengths):
            at = np.arange(len(part))
            classes, places = part // PLACES, part % PLACES
            total = np.zeros(len(part))
            for rows, prior, target in (
                (class_rows(before), self.class_prior, classes),
                (place_rows(before, classes), self.place_prior[classes], places),
            ):
                z = self.logits(self.weights, rows, prior)
                z -= z.max(axis=1, keepdims=True)
                total += z[at, target]
                total -= np.log(np.exp(z, out=z) @ ONES)
            out.append(total)
        return np.concatenate(out)


def _steps(ranks: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    before = history(ranks, lengths)
    for start in range(0, len(ranks), STEP_TOKENS):
        cut = slice(start, start + STEP_TOKENS)
        yield ranks[cut], [b[cut] for b in before]


def gradient(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of the log likelihood, by the logits, which it takes over."""
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z *= -1 / (z @ np.ones((z.shape[1], 1), z.dtype))
    z[np.arange(len(z)), target] += 1
    return z


class Trainer:
    """Gradient steps from a model's weights; each weight's rate falls with the gradients it has had."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = model.weights.copy()
        self.squares = np.ones_like(self.weights)
        self.visits = np.zeros(ROWS, dtype=np.int64)

    def _add(self, rows: list[np.ndarray], slope: np.ndarray) -> None:
        for column in rows:
            column = column.astype(np.uint16)  # sorted by radix
            order = np.argsort(column, kind="stable")
            column = column[order]
            first = np.flatnonzero(np.diff(column, prepend=ROWS) != 0)
            touched = column[first]
            added = np.add.reduceat(slope.take(order, axis=0), first, axis=0)
            squares = self.squares.take(touched, axis=0)
            squares += added * added
            self.squares[touched] = squares
            np.sqrt(squares, out=squares)
            added /= squares
            added *= RATE
            added += self.weights.take(touched, axis=0)
            self.weights[touched] = added
            self.visits[touched] += np.diff(first, append=len(column))

    def learn(self, ranks: np.ndarray, lengths: np.ndarray) -> None:
        for part, before in _steps(ranks, lengths):
            classes, places = part // PLACES, part % PLACES
            rows = class_rows(before)
            self._add(rows, gradient(self.model.logits(self.weights, rows, self.model.class_prior), classes))
            rows = place_rows(before, classes)
            self._add(rows, gradient(self.model.logits(self.weights, rows, self.model.place_prior[classes]), places))


def _ranks(model: Model, codes: bytes, symbols: bytes) -> np.ndarray:
    return model.rank[np.frombuffer(symbols, "<u2")][np.frombuffer(codes, "<u4")]


def _taught(ranks: np.ndarray, lengths: list[int], held: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    lengths, mine = np.array(lengths), ~np.array(held)
    return ranks[np.repeat(mine, lengths)], lengths[mine]


def _additions(blocks: DataFrame, model: Model) -> DataFrame:
    """What each task's steps add to the rows they touch, with how often they do."""
    sent = blocks.sparkSession.sparkContext.broadcast(model)

    def step(batches: Batches) -> Batches:
        trainer = Trainer(sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                trainer.learn(*_taught(_ranks(sent.value, row["codes"], row["symbols"]), row["lengths"], row["held"]))
        touched = np.flatnonzero(trainer.visits)
        added = (trainer.weights - sent.value.weights)[touched].astype("<f2")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(touched, pa.int64()),
                pa.array([TaskContext.get().partitionId()] * len(touched), pa.int64()),
                pa.array(trainer.visits[touched], pa.int64()),
                pa.array([a.tobytes() for a in added], pa.binary()),
            ],
            ["row", "task", "visits", "added"],
        )

    return mapped(blocks.select("lengths", "held", "codes", "symbols"), step, "row bigint, task bigint, visits bigint, added binary")


def _mean(key: tuple, group: pa.Table) -> pa.Table:
    """Means per row, weighted by visits."""
    row, visits = group["row"].to_numpy(), group["visits"].to_numpy()
    added = np.frombuffer(b"".join(group["added"].to_pylist()), "<f2").reshape(len(row), -1).astype(np.float64)
    order = np.argsort(row, kind="stable")
    rows, first = np.unique(row[order], return_index=True)
    total = np.add.reduceat(visits[order], first)
    mean = np.add.reduceat(added[order] * visits[order, None], first, axis=0) / total[:, None]
    out = [a.tobytes() for a in mean.astype("<f2")]
    return pa.table(
        [pa.array(rows), pa.array([key[-1].as_py()] * len(rows), pa.int64()), pa.array(total), pa.array(out, pa.binary())],
        ["row", "task", "visits", "added"],
    )


def _train(blocks: DataFrame, model: Model, rounds: int, per_slice: dict[int, int]) -> Model:
    """A round per slice. Means are taken in two levels, so that no group has a row per task."""
    for turn in range(rounds):
        tokens = per_slice.get(turn, 0)
        if not tokens:
            continue
        tasks = max(1, tokens // TASK_TOKENS)
        mine = blocks.filter(F.col("slice") == turn).coalesce(tasks)
        rows = _additions(mine, model)
        few = max(1, int(tasks**0.5))
        for level in (F.col("task") % few, F.lit(0).cast("bigint")):
            near = rows.withColumn("task", level).withColumn("near", F.expr("row div 512"))
            rows = near.groupBy("near", "task").applyInArrow(_mean, "row bigint, task bigint, visits bigint, added binary")
        for r in rows.select("row", "added").collect():  # ROWS rows at most
            model.weights[r.row] += np.frombuffer(r.added, "<f2")
    return model


# --- scores ---------------------------------------------------------------------------


def _score(model: Model) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def step(key: tuple, blocks: pa.Table, sums: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "held_out", "n_tokens", "n_known", "base_score", "score")}
        for row in blocks.to_pylist():
            symbols, codes = np.frombuffer(row["symbols"], "<u2"), np.frombuffer(row["codes"], "<u4")
            count = np.zeros(len(symbols), dtype=np.int64)
            for c, n in zip(sums["codes"].to_pylist(), sums["sums"].to_pylist(), strict=True):
                count[np.frombuffer(c, "<u4")] = np.frombuffer(n, "<i8")
            lengths = np.array(row["lengths"])
            first = np.cumsum(lengths) - lengths
            found = model.log_probability(model.rank[symbols][codes], lengths) / np.log(10)
            word = np.log10(count + 1.0) - model.shares[symbols]
            base = np.log10((count + 1) / (model.tokens + 1 * (model.words + 1)))
            out["doc_id"] += row["ids"]
            out["held_out"] += row["held"]
            out["n_tokens"] += lengths.tolist()
            out["n_known"] += np.add.reduceat((count > 0)[codes].astype(np.int64), first).tolist()
            out["base_score"] += np.add.reduceat(base[codes], first).tolist()
            out["score"] += np.add.reduceat(found + word[codes], first).tolist()
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], list(out))

    return step


def score(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    held: Column | None = None,
    rounds: int = ROUNDS,
    block_bytes: int = BLOCK_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Every document's log10 probability, learned from those not ``held`` out.

    Gives doc_id, held_out, n_tokens, n_known, train_tokens, base_score (by counts of single words,
    add-one) and score (by the model).
    """
    spark = documents.sparkSession
    blocks = _blocks(documents, doc_id, text, held_out(doc_id) if held is None else held, rounds, block_bytes)
    slices = blocks.groupBy("slice").agg(F.sum("word_bytes").alias("bytes"), F.sum("tokens").alias("tokens")).collect()
    parts = max(1, sum(r.bytes for r in slices) // part_bytes)
    sums = _dealt(blocks, parts).groupBy("part").applyInArrow(_summed, "block bigint, codes binary, sums binary")
    counted = written(sums, "word-counts")
    model = _train(blocks, Model(_symbol_sums(counted)), rounds, {r.slice: r.tokens for r in slices})
    sent = spark.sparkContext.broadcast(model)

    def step(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(sent.value)(key, left, right)

    asked = blocks.select("block", "ids", "held", "lengths", "codes", "symbols")
    scored = (
        asked.groupBy("block")
        .cogroup(counted.filter("block IS NOT NULL").groupBy("block"))
        .applyInArrow(step, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    )
    return scored.select(
        F.col("doc_id").alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score"
    )
