"""Token ids by the ``tokenizers`` library, each distinct word encoded once per worker.

A byte-pair tokenizer splits a text into words by a fixed pattern and merges within words
only. So a word's ids do not depend on its neighbours, and a worker keeps those it has seen.
Texts with characters outside a plain Latin range go to the library whole, so that no
difference between two Unicode tables can matter; so do texts that may spell a special token of the
file, which the library takes for that token.

Where a tokenizer drops white space, Arrow cuts texts there and finds the distinct pieces of a
batch, so that Python looks at each once a batch. A new word then goes to the library's model alone,
spelt as the file's byte level spells it.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Beyond this many words a worker starts its memory anew; results do not depend on it.
WORDS_KEPT = 1_400_000
# Texts are cut by Arrow as soon as they have this many characters together.
PIECES_CHARS = 1 << 22

_LATIN = [chr(c) for c in range(0xA1, 0x250) if c != 0x130]
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e" + "".join(_LATIN[:1]) + "-įı-ɏ]")


def _class(*kinds: str) -> str:
    chars = [chr(c) for c in range(0x20, 0x250)]
    return "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] in kinds)


_L, _N = _class("L"), _class("N")
# The patterns by which the two tokenizer files split a text.
_BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+"
_WORD_LEVEL = rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_L}{_N}]+"

# How a byte level spells bytes: those that print as themselves, the others as letters from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SPELT = {b: 0x100 + i for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of ``begins`` on, ``sizes`` of them, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """``encode(texts)`` gives an array of ids per text, as the library would.

    ``path`` is a file of the library. Two kinds are known: byte-level ones without a
    normalizer, and lower-casing ones that drop white space. Any other file works too, by
    encoding whole texts. A null text has no ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [token.content for token in self.library.get_added_tokens_decoder().values()]
        self.marks = sorted({form for token in added for form in (token[:2].lower(), token[:2].upper())})
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        pre = str(self.library.pre_tokenizer)
        if self.library.normalizer is None and pre.startswith("ByteLevel(add_prefix_space=False"):
            self.split, self.lower = re.compile(_BYTE_LEVEL).findall, False
        elif (
            "Lowercase()" in str(self.library.normalizer)
            and "behavior=Removed" in pre
            and "ByteLevel(add_prefix_space=False" in pre
        ):
            self.split, self.lower, self.model = re.compile(_WORD_LEVEL).findall, True, self.library.model
        else:
            self.split, self.lower = None, False
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[str]) -> None:
        """Encode new words, all in one text; one by one where the library splits it otherwise."""
        plain = [w for w in words if not w.isspace()]
        if len(self.known) + len(words) > WORDS_KEPT:
            self.known.clear()
        found = self.library.encode("\n".join(plain), add_special_tokens=False)
        at = np.array(found.word_ids, dtype=np.int64)
        if len(at) and at[-1] == 2 * (len(plain) - 1):
            ids = np.array(found.ids, dtype="<u4")
            cuts = np.searchsorted(at, np.arange(0, 2 * len(plain) + 1))
            for i, word in enumerate(plain):
                self.known[word] = ids[cuts[2 * i] : cuts[2 * i + 1]].tobytes()
        else:
            words = plain + words
        for word in words:
            if word not in self.known:
                self.known[word] = self.whole(word).tobytes()

    def _new(self, word: str) -> bytes:
        """The ids of a word not known yet, of a tokenizer that drops white space."""
        if len(self.known) >= WORDS_KEPT:
            self.known.clear()
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(_SPELT)
        found = self.known[word] = array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        return found

    def _pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of lower-case texts for a tokenizer that drops white space."""
        parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        pieces = parts.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        split, get, new = self.split, self.known.get, self._new
        found = list(map(get, distinct))
        for i in [i for i, ids in enumerate(found) if ids is None]:
            piece = distinct[i]
            # Most often a known word and one mark, which is then a word of its own.
            if piece[-2:-1].isalnum() and not piece[-1].isalnum() and (ids := get(piece[:-1])) is not None:
                found[i] = ids + (get(piece[-1]) or new(piece[-1]))
                continue
            words = split(piece)
            found[i] = new(piece) if len(words) == 1 else b"".join([get(w) or new(w) for w in words])
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, at = np.frombuffer(b"".join(found), dtype="<u4"), pieces.indices.to_numpy()
        sizes = lengths[at]
        out = flat[ranges((np.cumsum(lengths) - lengths)[at], sizes)]
        cuts = np.append(0, np.cumsum(sizes))[parts.offsets.to_numpy()]
        return np.split(out, cuts[1:-1])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        plain: dict[int, str] = {}
        held = 0
        known = self.known

        def close() -> None:
            nonlocal held
            if plain:
                for at, ids in zip(plain, self._pieces(list(plain.values())), strict=True):
                    out[at] = ids
            plain.clear()
            held = 0

        for text in texts:
            if not text:
                out.append(np.zeros(0, dtype="<u4"))
                continue
            cased = text.lower() if self.lower else text
            if (
                self.split is None
                or any(m in text for m in self.marks)
                or _PLAIN.search(text)
                or (self.lower and not cased.isascii() and _PLAIN.search(cased))
            ):
                out.append(self.whole(text))
                continue
            if self.lower:
                plain[len(out)] = cased
                out.append(np.zeros(0, dtype="<u4"))
                held += len(text)
                if held >= PIECES_CHARS:
                    close()
                continue
            words = self.split(text)
            try:
                found = b"".join([known[w] for w in words])
            except KeyError:
                new = list(dict.fromkeys(w for w in words if w not in known))
                if len(known) + len(new) > WORDS_KEPT:
                    known.clear()
                    new = list(dict.fromkeys(words))
                self._learn(new)
                found = b"".join([known[w] for w in words])
            out.append(np.frombuffer(found, dtype="<u4"))
        close()
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker and file."""
    return Encoder(path)
