"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger holds the measurements and one bit
per failed rule; policies, which are versioned sets of rules, and questions such as "what
would one rule less let through?" are bitwise work on that ledger and never read a text.

Null and empty texts have no words. Rows are judged one by one, so repeated rows and ties
are all kept; a null id stays null. Very long texts are measured whole, and an empty table gives an empty
ledger. Columns other than the id and the text are not read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steward.llm.shared import Batches, written

# White space is what ASCII has of it: space and the five controls 9 to 13.
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_HIGH = bytes(range(128, 256))


def _all_but(*kept: bytes) -> bytes:
    return bytes(sorted(set(range(256)) - set(b"".join((_SPACE, *kept)))))


_NOT_LETTER = _all_but(_UPPER, _LOWER, _HIGH)
_NOT_ASCII_LETTER = _all_but(_UPPER, _LOWER)
_NOT_LOWER = _all_but(_LOWER)
_SYMBOLS = b"#*$%&|<>"

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_lettered", "n_capitals", "n_marks",
)
WINDOW = 5


def repeated_words(words: list[bytes], window: int = WINDOW) -> tuple[int, int]:
    """Distinct words, and words that lie in a window of words found at least twice."""
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64)
    n, base = len(ids), max(2, len(index))
    if n <= window:
        return len(index), 0
    keys, radix = ids[: n - window + 1], base
    for k in range(1, window):
        if radix * base >= 2**62:  # number the distinct keys anew before they overflow
            kinds, keys = np.unique(keys, return_inverse=True)
            radix = len(kinds)
        keys = keys * base + ids[k : n - window + 1 + k]
        radix *= base
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return len(index), 0
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    starts = np.flatnonzero(twice[at] == keys)
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return len(index), int(np.count_nonzero(np.cumsum(edges)[:n]))


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``."""
    data = (text or "").encode()
    words = data.split()
    spaces = len(data) - len(data.translate(None, _SPACE))
    lines = [line for line in data.split(b"\n") if line.strip(_SPACE)]
    distinct, repeated = repeated_words(words)
    return (
        len(words),
        len(text or "") - spaces,
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        distinct,
        len(data.translate(None, _NOT_LETTER).split()),
        len(data.translate(None, _NOT_ASCII_LETTER).split())
        - len(data.translate(None, _NOT_LOWER).split()),
        data.count(b"!") + data.count(b"?"),
    )


# A rule tells from the measurements, which it is handed by name, whether a document fails it.
Measures = Callable[[str], Column]

# The place of a rule is its bit and never changes; new rules are added at the end, with a new version.
RULES: dict[str, Callable[[Measures], Column]] = {
    "few_words": lambda m: m("n_words") < 10,
    "repeated_words": lambda m: 100 * m("n_repeat_words") > 20 * m("n_words"),
    "symbols": lambda m: 10 * m("n_symbols") > m("n_words"),
    "capitals": lambda m: 10 * m("n_capitals") > 3 * m("n_words"),
    "marks": lambda m: 2 * m("n_marks") > m("n_words"),
    "letterless": lambda m: 10 * m("n_lettered") < 7 * m("n_words"),
    "repeated_lines": lambda m: 100 * m("n_dup_lines") > 40 * m("n_lines"),
    "few_distinct": lambda m: (m("n_words") >= 50) & (10 * m("n_distinct_words") < 3 * m("n_words")),
}
RULES_VERSION = 1


@dataclass(frozen=True)
class Policy:
    """A version of a set of rules, any of which rejects a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << list(RULES).index(r) for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
CLEAN = Policy("clean", 1, tuple(RULES))


def _measured(id_: str) -> object:
    def step(batches: Batches) -> Batches:
        for batch in batches:
            rows = [measure(t) for t in batch.column("text").to_pylist()]
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(MEASURES)).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_), *(pa.array(c) for c in columns)], [id_, *MEASURES]
            )

    return step


def failed_bits(measures: Measures) -> Column:
    """One bit per failed rule."""
    bits = [F.when(rule(measures), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, rule in enumerate(RULES.values())]
    return reduce(Column.bitwiseOR, bits).cast("bigint")


def ledger(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, the measurements, ``failed`` with a bit per failed rule, and the rules' version."""
    narrow = docs.select(id_, F.col(text).alias("text"))
    kind = docs.schema[id_].dataType.simpleString()
    schema = ", ".join([f"`{id_}` {kind}", *(f"{m} bigint" for m in MEASURES)])
    measured = narrow.mapInArrow(_measured(id_), schema)
    return measured.withColumn("failed", failed_bits(F.col)).withColumn("rules_version", F.lit(RULES_VERSION))


def stored_ledger(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The ledger, evaluated and written once; any number of policies and ablations read it."""
    return written(ledger(docs, id_, text), "quality-ledger")


def kept(policy: Policy, failed: Column | None = None) -> Column:
    """Whether ``policy`` keeps the document whose failure bits these are."""
    failed = F.col("failed") if failed is None else failed
    return failed.bitwiseAND(F.lit(policy.mask)) == 0


def ablations(book: DataFrame, policies: list[Policy]) -> DataFrame:
    """Per policy and rule: documents that fail the rule, that only this rule rejects, and
    how many the policy keeps with it and without it.

    Documents are first counted by their bits, so no more than one row per set of bits
    and task is shuffled.
    """
    counts = book.groupBy("failed").agg(F.count("*").alias("n"))
    asked = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("policy"),
                F.lit(p.version).alias("version"),
                F.lit(rule).alias("rule"),
                F.lit(p.mask).cast("bigint").alias("mask"),
                F.lit(1 << list(RULES).index(rule)).cast("bigint").alias("bit"),
            )
            for p in policies
            for rule in p.rules
        ]
    )
    hit = F.col("failed").bitwiseAND(F.col("mask"))

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    return (
        counts.select("failed", "n", F.inline(asked))
        .groupBy("policy", "version", "rule")
        .agg(
            total(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
            total(hit == F.col("bit")).alias("n_only"),
            total(hit == 0).alias("n_kept"),
            total(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        )
    )


def failures_by(book: DataFrame, *keys: str) -> DataFrame:
    """Per group: the rules that any of its documents fails, and those that all fail."""
    return book.groupBy(*keys).agg(
        F.bit_or("failed").alias("any_failed"),
        F.bit_and("failed").alias("all_failed"),
        F.count("*").alias("n_docs"),
    )


def keep_clean(docs: DataFrame, policy: Policy = CLEAN, text: str = "text") -> DataFrame:
    """The documents that ``policy`` keeps, with all columns they came with.

    The measurements ride along with the row, so no join is needed: the same bits as in the ledger
    are set, and the policy's mask is held against them.
    """
    found = "_measured"
    while found in docs.columns:
        found += "_"
    at = docs.columns.index(text)

    def step(batches: Batches) -> Batches:
        for batch in batches:
            rows = [measure(t) for t in batch.column(at).to_pylist()]
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(MEASURES)).T
            measured = pa.StructArray.from_arrays([pa.array(c) for c in columns], list(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, measured], [*batch.schema.names, found]
            )

    kind = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])
    judged = docs.mapInArrow(step, T.StructType([*docs.schema.fields, T.StructField(found, kind)]))
    return judged.filter(kept(policy, failed_bits(lambda m: F.col(found)[m]))).drop(found)
