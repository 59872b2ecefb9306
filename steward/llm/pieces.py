"""SentencePiece encoding with seeded merge-dropout, and its decoding.

Merges wait in an agenda, the best score first and the leftmost of equals. Each one
taken from it is skipped if a keyed hash of seed, document, the word's place in it, merge and place
in the word falls below the dropout rate, as if that neighbourhood had never been there. So
every occurrence of a word has draws of its own; the segmentation is the same whenever
it is run again, and always decodes to the text. With rate 0 it is the library's own.

A worker keeps, per word, the tree of agendas its draws have led to: a node is the merge on
top, its two children follow from taking and from skipping it, a leaf is a segmentation. All
occurrences in a slice of words go down their trees together, one merge at a time; those
that leave the known part are merged anew and extend it.

A null text has no ids and decodes to null; an empty text has none and decodes to the
empty text. The mark that stands for a space is spelled in bytes where a text holds it itself.
Repeated rows are encoded as often as they occur, alike where their ids are alike, as are rows
without an id; extra columns, whatever their names, are not read. Very long texts are worked
off in slices of words. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from steward.llm.shared import Batches, batches_of

DROPOUT, SEED = 0.1, 42
LEAVES_KEPT = 600_000  # per worker; results do not depend on it
_MARK = "▁"
_SHORT = 64  # characters; longer words keep their agenda in a heap, and are not remembered
_CHARS = 1 << 20  # of texts whose words are looked up together
_WORDS = 1 << 17  # that go down their trees together
_MASK = (1 << 64) - 1
_WORD = re.compile(r" *[^ ]+| +")


def _skipped(key: int, place: int, merge: int, bar: int) -> bool:
    """Whether a keyed hash of a merge and its place falls below ``bar`` of 2**32."""
    x = key + place * 0x9E3779B1 + merge * 0x85EBCA6B & 0xFFFFFFFF
    x = (x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
    x = (x ^ x >> 12) * 0x297A2D39 & 0xFFFFFFFF
    return (x ^ x >> 15) < bar


def _drawn(key: np.ndarray, place: np.ndarray, merge: np.ndarray, bar: int) -> np.ndarray:
    """``_skipped`` for many at a time."""
    low, of = np.uint64(0xFFFFFFFF), np.uint64
    x = key + place.astype(np.uint64) * of(0x9E3779B1) + merge.astype(np.uint64) * of(0x85EBCA6B) & low
    x = (x ^ x >> of(15)) * of(0x2C1B3C6D) & low
    x = (x ^ x >> of(12)) * of(0x297A2D39) & low
    return (x ^ x >> of(15)) < of(bar)


def _keys(doc: object, n: int, seed: int) -> np.ndarray:
    """A key of 32 bits for each of a document's ``n`` words."""
    start = np.uint64(xxhash.xxh64_intdigest(str(doc).encode(), seed & _MASK))
    x = start + np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return x >> np.uint64(32)


class Trees:
    """Per word, the agendas that draws have led to so far.

    Node k offers merge ``merge[k]`` at ``place[k]``; taking it leads to node ``child[k]``, skipping it to
    the next one. A node not reached yet has merge ``NEW``; one with nothing left to merge has
    ``LEAF``, and ``child`` is then the number of its segmentation.
    """

    NEW, LEAF = -1, -2

    def __init__(self) -> None:
        self.roots: dict[str, int] = {}
        self.leaves: list[bytes] = [b""]
        self.used = 0
        self.place, self.child = np.zeros((2, 1 << 12), dtype=np.int32)
        self.merge = np.full(1 << 12, self.NEW, dtype=np.int32)

    def _nodes(self, n: int) -> int:
        """The first of ``n`` new nodes."""
        first, self.used = self.used, self.used + n
        if self.used > len(self.merge):
            more = max(self.used, 2 * len(self.merge)) - len(self.merge)
            self.place, self.child = (np.append(x, np.zeros(more, dtype=np.int32)) for x in (self.place, self.child))
            self.merge = np.append(self.merge, np.full(more, self.NEW, dtype=np.int32))
        return first

    def root(self, word: str) -> int:
        self.roots[word] = at = self._nodes(1)
        return at

    def step(self, node: np.ndarray, place: np.ndarray, merge: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Where ``node`` leads; new ones, all of them different, get their merge and two new nodes."""
        new = self.merge[node] == self.NEW
        made = node[new]
        first = self._nodes(2 * len(made))
        self.place[made], self.merge[made] = place[new], merge[new]
        self.child[made] = first + 2 * np.arange(len(made))
        return self.child[node] + skip

    def end(self, node: np.ndarray, found: list[bytes]) -> None:
        self.merge[node] = self.LEAF
        self.child[node] = len(self.leaves) + np.arange(len(found))
        self.leaves += found

    def descend(self, node: np.ndarray, going: np.ndarray, key: np.ndarray, bar: int) -> np.ndarray:
        """Move ``node`` of those ``going`` down by their draws; gives those that came to a new node."""
        stuck = [going[:0]]
        while len(going):
            at = node[going]
            merge = self.merge[at]
            inner = merge >= 0
            if not inner.all():
                stuck.append(going[merge == self.NEW])
                going, at, merge = going[inner], at[inner], merge[inner]
            skip = _drawn(key[going], self.place[at], merge, bar) if bar else 0
            node[going] = self.child[at] + skip
        return np.concatenate(stuck)


class Pieces:
    """The vocabulary of a byte-pair model with byte fallback, and its merges."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(size):
            piece = self.library.id_to_piece(i)
            self.scores.append(self.library.get_score(i))
            if self.library.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(_MARK, " ").encode())
        # Words can be cut before spaces if no piece holds a space after something else.
        best = sorted(self.ids, key=lambda p: (-self.scores[self.ids[p]], self.ids[p]))
        self.rank = {p: r for r, p in enumerate(best) if len(p) > 1}
        self.apart = not any(_MARK in p.lstrip(_MARK) for p in self.ids)
        self._pair_table(best)
        self.trees = Trees()

    def _pair_table(self, best: list[str]) -> None:
        """What ``_merged_many`` needs: numbers of characters, and the rank of each neighbour pair.

        A piece is numbered by its id, a character that is none by a number beyond; ``none`` is
        what is in no piece at all, and pairs with nothing.
        """
        self.none = len(self.scores)
        letters = sorted({c for p in self.ids for c in p})
        beyond = iter(range(self.none + 1, self.none + 1 + len(letters)))
        number = self.ids | {c: next(beyond) for c in letters if c not in self.ids}
        self.letters = np.array([ord(c) for c in letters], dtype=np.uint32)
        self.numbers = np.array([number[c] for c in letters], dtype=np.int64)
        self.width = self.none + 1 + len(letters)
        self.made = np.array([self.ids[p] for p in best], dtype=np.int64)
        found = [
            (number[a] * self.width + number[b], r)
            for p, r in self.rank.items()
            for a, b in ((p[:k], p[k:]) for k in range(1, len(p)))
            if a in number and b in number
        ]
        pairs = np.array(sorted(found), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.pair_rank = pairs[:, 0].copy(), np.append(pairs[:, 1], len(best))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what two neighbours make; the number of pieces where that is none."""
        if not len(self.pairs):
            return np.full(left.shape, self.pair_rank[-1])
        asked = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return np.where(self.pairs[at] == asked, self.pair_rank[at], self.pair_rank[-1])

    def segment(self, word: str, rate: float, key: int) -> list[int]:
        """Ids of one word, a space written as a space."""
        # A mark of its own is no space: it never merges, and is spelled in bytes.
        parts = list(word.replace(_MARK, "\0").replace(" ", _MARK))
        merge = self._merged if len(parts) <= _SHORT else self._merged_long
        get = self.ids.get
        found = [get(part) for part in merge(parts, int(rate * 2**32), key)]
        if None not in found:
            return found
        out: list[int] = []
        for part, i in zip(parts, found, strict=True):
            if i is not None:
                out.append(i)
            else:
                spelled = _MARK if part == "\0" and "\0" not in word else part
                out += [self.byte_ids[v] for v in spelled.encode()]
        return out

    def _merged(self, parts: list[str], bar: int, key: int) -> list[str]:
        """``parts`` merged in place; the agenda is a list that holds the rank of each neighbour pair."""
        rank, none = self.rank.get, len(self.ids)
        agenda = [rank(a + b, none) for a, b in pairwise(parts)]
        places = list(range(len(parts)))
        while agenda and (best := min(agenda)) != none:
            i = agenda.index(best)
            if bar:  # as _skipped, spelled out where it runs most
                x = key + places[i] * 0x9E3779B1 + best * 0x85EBCA6B & 0xFFFFFFFF
                x = (x ^ x >> 15) * 0x2C1B3C6D & 0xFFFFFFFF
                x = (x ^ x >> 12) * 0x297A2D39 & 0xFFFFFFFF
                if (x ^ x >> 15) < bar:
                    agenda[i] = none
                    continue
            j = i + 1
            joint = parts[i] = parts[i] + parts[j]
            del parts[j], places[j], agenda[i]
            if i < len(agenda):
                agenda[i] = rank(joint + parts[j], none)
            if i:
                agenda[i - 1] = rank(parts[i - 1] + joint, none)
        return parts

    def _merged_many(
        self, words: list[str], bar: int, keys: np.ndarray, trees: Trees | None = None, node: np.ndarray | None = None
    ) -> list[bytes]:
        """Ids, as bytes, of many words of at most ``_SHORT`` characters, none of them with a mark of its own.

        As ``_merged``, one step of every word at a time: a row is a word, a column the place
        of a part's first character. With ``trees``, what each word's draws lead to is added below
        ``node``, its root; no two words may leave the known part at one node.
        """
        n, longest = len(words), max(map(len, words))
        padded = "".join([w.ljust(longest + 1, "\0") for w in words]).replace(" ", _MARK)
        codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(n, longest + 1)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        parts = np.where(self.letters[at] == codes, self.numbers[at], self.none)
        # The last column belongs to no word, and stands for what is beyond either end.
        sizes = np.array([len(w) for w in words])
        parts[np.arange(longest + 1) >= sizes[:, None]] = self.none
        after = np.tile(np.arange(1, longest + 2), (n, 1))
        before = np.tile(np.arange(-1, longest), (n, 1))
        agenda = np.full((n, longest + 1), self.pair_rank[-1])
        agenda[:, :-1] = self._ranks(parts[:, :-1], parts[:, 1:])
        key, none = np.asarray(keys, dtype=np.uint64), self.pair_rank[-1]
        gone = np.zeros(parts.shape, dtype=bool)
        row = np.arange(n)
        while len(row):
            i = agenda[row].argmin(axis=1)
            merge = agenda[row, i]
            live = merge != none
            row, i, merge = row[live], i[live], merge[live]
            if bar:
                skip = _drawn(key[row], i, merge, bar)
                if trees:
                    node[row] = trees.step(node[row], i, merge, skip)
                agenda[row[skip], i[skip]] = none
                r, i, merge = row[~skip], i[~skip], merge[~skip]
            else:
                r = row
                if trees:
                    node[row] = trees.step(node[row], i, merge, np.zeros(len(row), dtype=bool))
            j, k = after[r, i], before[r, i]
            beyond = after[r, j]
            gone[r, j], agenda[r, j] = True, none
            parts[r, i], after[r, i], before[r, beyond] = self.made[merge], beyond, i
            agenda[r, i] = self._ranks(parts[r, i], parts[r, beyond])
            agenda[r, k] = self._ranks(parts[r, k], parts[r, i])
        stays = ~gone & (np.arange(longest + 1) < sizes[:, None])
        flat, ends = parts[stays].astype("<u4").tobytes(), (4 * np.cumsum(stays.sum(axis=1))).tolist()
        out = [flat[a:b] for a, b in pairwise([0, *ends])]
        for w in np.flatnonzero((stays & (parts >= self.none)).any(axis=1)).tolist():
            ids: list[int] = []
            for place in np.flatnonzero(stays[w]).tolist():
                i = int(parts[w, place])
                ids += [i] if i < self.none else [self.byte_ids[v] for v in words[w][place].encode()]
            out[w] = np.array(ids, dtype="<u4").tobytes()
        if trees:
            trees.end(node, out)
        return out

    def _merged_long(self, parts: list[str], bar: int, key: int) -> list[str]:
        """The same for long words, with the agenda in a heap."""
        rank, n = self.rank.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and (r := rank(parts[a] + parts[b])) is not None:
                heapq.heappush(agenda, (r, a, b, parts[a] + parts[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        while agenda:
            r, a, b, piece = heapq.heappop(agenda)
            if not parts[a] or not parts[b] or after[a] != b or parts[a] + parts[b] != piece:
                continue
            if bar and _skipped(key, a, r, bar):
                continue
            parts[a], parts[b] = piece, ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        parts[:] = [p for p in parts if p]
        return parts

    def encode(self, text: str, rate: float = 0.0, seed: int = SEED, doc: object = None) -> np.ndarray:
        """Ids of a whole text, without any of begin or end."""
        return self.encode_many([(doc, text)], rate, seed)[0]

    def encode_many(self, docs: list[tuple[object, str]], rate: float = 0.0, seed: int = SEED) -> list[np.ndarray]:
        """Ids of whole texts, each with its document's id."""
        words: list[str] = []
        keys, ends = [np.zeros(0, dtype=np.uint64)], [0]
        for doc, text in docs:
            found = self._words(text)
            words += found
            keys.append(_keys(doc, len(found), seed))
            ends.append(len(words))
        key, parts = np.concatenate(keys), []
        for at in range(0, len(words), _WORDS):
            parts += self._segmented(words[at : at + _WORDS], rate, key[at : at + _WORDS])
        return [np.frombuffer(b"".join(parts[a:b]), dtype="<u4") for a, b in pairwise(ends)]

    def _words(self, text: str) -> list[str]:
        """The words of a text, each with its space."""
        if not text:
            return []
        spaced = " " + text
        return _WORD.findall(spaced) if self.apart else [spaced]

    def _segmented(self, words: list[str], rate: float, key: np.ndarray) -> list[bytes]:
        """Ids, as bytes, of each occurrence of a word, by its own draws."""
        trees, bar = self.trees, int(rate * 2**32)
        if len(trees.leaves) > LEAVES_KEPT:
            trees = self.trees = Trees()
        get = trees.roots.get
        roots = [get(w) for w in words]
        alone = []
        for k, w in enumerate(words):
            if roots[k] is None:
                if len(w) > _SHORT or _MARK in w:
                    roots[k] = -1
                    alone.append(k)
                else:
                    roots[k] = trees.root(w)
        node = np.array(roots, dtype=np.int64)
        first = node.copy()
        going = np.flatnonzero(node >= 0)
        while len(going):
            stuck = trees.descend(node, going, key, bar)
            _, one = np.unique(node[stuck], return_index=True)
            self._grow([words[k] for k in stuck[one].tolist()], bar, key[stuck[one]], first[stuck[one]])
            going = stuck
        at = trees.child[node]
        at[alone] = 0
        out = list(map(trees.leaves.__getitem__, at.tolist()))
        for k in alone:
            out[k] = np.array(self.segment(words[k], rate, int(key[k])), dtype="<u4").tobytes()
        return out

    def _grow(self, words: list[str], bar: int, key: np.ndarray, root: np.ndarray) -> None:
        """Add what these occurrences' draws lead to; words of like length go together, as rows are as wide as the longest."""
        size = np.array(list(map(len, words)), dtype=np.int64)
        kind = np.searchsorted([8, 12, 16], size)
        for k in range(4):
            alike = np.flatnonzero(kind == k)
            for a in range(0, len(alike), 1 << 13):
                some = alike[a : a + (1 << 13)]
                self._merged_many([words[i] for i in some.tolist()], bar, key[some], self.trees, root[some])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space put before the first word is taken off."""
        return b"".join([self.bytes_of[i] for i in ids.tolist()])[1:].decode(errors="replace")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _encoded(
    model: Pieces, rows: list[tuple[object, str | None]], rate: float, seed: int
) -> Iterator[np.ndarray | None]:
    """Ids of each text of ``rows``, null for null; some texts are taken at a time, a very long one by itself."""
    at = 0
    while at < len(rows):
        end, held = at, 0
        while end < len(rows) and (end == at or held + len(rows[end][1] or "") <= _CHARS):
            held += len(rows[end][1] or "")
            end += 1
        some = rows[at:end]
        found = iter(model.encode_many([r for r in some if r[1] is not None], rate, seed))
        yield from [None if text is None else next(found) for _, text in some]
        at = end


def encode(
    docs: DataFrame,
    model: str,
    rate: float = DROPOUT,
    seed: int = SEED,
    id_: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """(id, n_tokens, ids): ids as little-endian unsigned 32-bit integers; null for a null text."""
    kind = docs.schema[id_].dataType.simpleString()

    def step(batches: Batches) -> Batches:
        model_ = pieces(model)
        for whole in batches:
            for batch in batches_of(whole, 256):
                rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                ids = list(_encoded(model_, list(rows), rate, seed))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([0 if i is None else len(i) for i in ids], pa.int64()),
                        pa.array([None if i is None else i.tobytes() for i in ids], pa.binary()),
                    ],
                    [id_, "n_tokens", "ids"],
                )

    return docs.select(id_, F.col(text).alias("_text")).mapInArrow(step, f"`{id_}` {kind}, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, model: str, id_: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, n_tokens, text) of encoded rows."""
    kind = encoded.schema[id_].dataType.simpleString()

    def step(batches: Batches) -> Batches:
        model_ = pieces(model)
        for whole in batches:
            for batch in batches_of(whole, 256):
                rows = batch.column(2).to_pylist()
                texts = [None if r is None else model_.decode(np.frombuffer(r, dtype="<u4")) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string())], [id_, "n_tokens", "text"]
                )

    return encoded.select(id_, "n_tokens", ids).mapInArrow(step, f"`{id_}` {kind}, n_tokens bigint, text string")


def round_trip(
    docs: DataFrame,
    model: str,
    rate: float = DROPOUT,
    seed: int = SEED,
    id_: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Per row: id, ``n_tokens``, checksums of ids and of the decoded text, and ``lossless``.

    Ids are encoded, then decoded from their bytes in the same task, so nothing is joined.
    Null texts have null checksums and come back as they were.
    """
    kind = docs.schema[id_].dataType.simpleString()
    names = [id_, "n_tokens", "ids_crc32", "text_crc32", "lossless"]

    def step(batches: Batches) -> Batches:
        model_ = pieces(model)
        for whole in batches:
            for batch in batches_of(whole, 256):
                rows = []
                given = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                for (_, text_), ids in zip(given, _encoded(model_, given, rate, seed), strict=True):
                    if ids is None:
                        rows.append((0, None, None, True))
                        continue
                    back = model_.decode(ids)
                    rows.append((len(ids), crc32(ids), crc32(back.encode()), back == text_))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names
                )

    schema = f"`{id_}` {kind}, n_tokens bigint, ids_crc32 bigint, text_crc32 bigint, lossless boolean"
    return docs.select(id_, F.col(text).alias("_text")).mapInArrow(step, schema)
