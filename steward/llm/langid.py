"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ones and minus ones, drawn from its code point alone. A
run of three letters is the product of their vectors, each rolled by its place (binding keeps
order apart). A text is the sum of its runs (bundling), and a language the sum of its texts'
unit vectors. A text gets the language whose prototype has the highest cosine with it.

Runs are taken within words, with a space at either end. Prototypes are summed as integers, so
they do not depend on the order of rows. Null texts and texts without letters are ``und`` with
score 0, as is everything when nothing was learned. Ties go to the first language by name.
Rows are judged one by one: repeated rows stay; extra columns are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steward.llm.shared import Batches, batches_of

DIM, GRAM, SEED = 512, 3, 7
UNKNOWN = "und"
RUNS_KEPT = 40_000  # vectors a worker remembers; results do not depend on it
_UNIT = 1 << 20  # a unit vector is summed in these steps
# What counts as alphanumeric but is neither a letter nor a digit: fractions, Roman numerals, circled numbers.
_NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No"))
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    text = text.lower()
    if not text.isascii() and not _NUMBERS.isdisjoint(text):
        text = "".join(" " if c in _NUMBERS else c for c in text)
    return _WORDS.findall(text)
_PART, _TEXTS = 50_000, 64  # words and texts bundled at a time


class Bundler:
    """Unit vectors of texts; remembers those of letter runs.

    The runs of a batch of texts are looked up together, so that bundling is one product of a
    matrix of counts and one of vectors.
    """

    def __init__(self) -> None:
        self._forget()

    def _forget(self) -> None:
        self.letters: dict[int, int] = {}
        # A letter's vector as first, middle and last of a run.
        self.tables = [np.zeros((0, DIM), dtype=np.float32)] * GRAM
        self.codes = np.zeros(0, dtype=np.int64)  # sorted, with the row of each vector
        self.rows = np.zeros(0, dtype=np.int64)
        self.vectors = np.zeros((0, DIM), dtype=np.float32)

    def _letters(self, points: np.ndarray) -> np.ndarray:
        """Rows of these code points in the tables, new ones drawn."""
        fresh = [c for c in dict.fromkeys(points.tolist()) if c not in self.letters]
        if fresh:
            drawn = []
            for c in fresh:
                self.letters[c] = len(self.letters)
                words = [xxhash.xxh64_intdigest(f"{c} {k}".encode(), SEED) for k in range(DIM // 64)]
                bits = np.unpackbits(np.array(words, dtype=">u8").view(np.uint8))
                drawn.append(bits.astype(np.float32) * 2 - 1)
            new = np.stack(drawn)
            self.tables = [
                np.concatenate([t, np.roll(new, GRAM - 1 - place, axis=1)])
                for place, t in enumerate(self.tables)
            ]
        return np.array([self.letters[c] for c in points.tolist()], dtype=np.int64)

    def _bound(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of runs: the product of their letters' vectors, each rolled by its place."""
        out = np.ones((len(codes), DIM), dtype=np.float32)
        for place in range(GRAM):
            points = codes >> (21 * (GRAM - 1 - place)) & 0x1FFFFF
            at = self._letters(points)
            out *= self.tables[place][at]
        return out

    def _learned(self, codes: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for sorted distinct codes."""
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), dtype=bool)
        inside = at < len(self.codes)
        known[inside] = self.codes[at[inside]] == codes[inside]
        if not known.all():
            new = codes[~known]
            if len(self.codes) + len(new) > RUNS_KEPT:
                self._forget()
                new = codes
            first = len(self.vectors)
            self.vectors = np.concatenate([self.vectors, self._bound(new)])
            both = np.r_[self.codes, new]
            rows = np.r_[self.rows, first + np.arange(len(new))]
            order = np.argsort(both)
            self.codes, self.rows = both[order], rows[order]
            at = np.searchsorted(self.codes, codes)
        return self.rows[at]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One vector of length one per whole text, or zeros if it has no letters."""
        totals = np.zeros((len(texts), DIM))
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        for i, text in enumerate(texts):
            words = words_of(text) if text else []
            for k in range(0, len(words), _PART):
                spaced = f" {' '.join(words[k : k + _PART])} "
                points = np.frombuffer(spaced.encode("utf-32-le"), dtype="<u4").astype(np.int64)
                codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
                found.append((i, *np.unique(codes[points[1:-1] != 32], return_counts=True)))
        if not found:
            return totals
        all_codes = np.unique(np.concatenate([f[1] for f in found]))
        for c in range(0, len(all_codes), 8192):
            part = all_codes[c : c + 8192]
            rows = self._learned(part)
            counts = np.zeros((len(texts), len(part)), dtype=np.float32)
            for i, codes, n in found:
                low, high = np.searchsorted(codes, [part[0], part[-1] + 1])
                counts[i, np.searchsorted(part, codes[low:high])] += n[low:high]
            totals += counts @ self.vectors[rows]
        sizes = np.linalg.norm(totals, axis=1)
        return totals / np.where(sizes > 0, sizes, 1)[:, None]


@lru_cache(maxsize=1)
def bundler() -> Bundler:
    return Bundler()


@dataclass(frozen=True)
class Profiles:
    """Language names, in order, and their prototypes of length one."""

    names: tuple[str, ...]
    vectors: np.ndarray

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The nearest language of each text and its cosine; below zero counts as zero."""
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        vectors = bundler().bundle(texts)
        cosines = vectors @ self.vectors.T
        best = cosines.argmax(axis=1)
        some = vectors.any(axis=1)
        names = [self.names[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)]
        return names, np.where(some, np.clip(cosines[np.arange(len(best)), best], 0, 1), 0.0)


def held_out(id_: str = "doc_id") -> Column:
    """A fifth of all ids, by their checksum as text; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, lang: str = "lang", text: str = "text") -> Profiles:
    """Prototypes from all rows of ``docs`` whose language is not null.

    Every task sums per language; the driver gets one vector per language.
    """

    def step(batches: Batches) -> Batches:
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in batches_of(whole, _TEXTS):
                vectors = np.rint(bundler().bundle(batch.column(1).to_pylist()) * _UNIT).astype(np.int64)
                langs = np.array(batch.column(0).to_pylist(), dtype=object)
                for name in dict.fromkeys(langs[vectors.any(axis=1)].tolist()):
                    total = sums.setdefault(name, np.zeros(DIM, dtype=np.int64))
                    total += vectors[langs == name].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
                ["lang", "vector"],
            )

    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = rows.mapInArrow(step, "lang string, vector array<bigint>")
    summed = found.select("lang", F.posexplode("vector").alias("at", "v")).groupBy("lang", "at").agg(F.sum("v").alias("v"))
    by_lang: dict[str, np.ndarray] = {}
    for r in summed.collect():
        by_lang.setdefault(r.lang, np.zeros(DIM))[r["at"]] = r.v
    names = tuple(sorted(by_lang))
    vectors = np.stack([by_lang[n] / max(np.linalg.norm(by_lang[n]), 1e-9) for n in names]) if names else np.zeros((0, DIM))
    return Profiles(names, vectors)


def predict(
    docs: DataFrame, profiles: Profiles, text: str = "text", lang_as: str = "lang_pred", score_as: str = "score"
) -> DataFrame:
    """``docs`` with the language found for each text and its score."""
    at = docs.columns.index(text)

    def step(batches: Batches) -> Batches:
        for whole in batches:
            for batch in batches_of(whole, _TEXTS):
                names, scores = profiles.judge(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(scores)],
                    [*batch.schema.names, lang_as, score_as],
                )

    added = [T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())]
    return docs.mapInArrow(step, T.StructType([*docs.schema.fields, *added]))
