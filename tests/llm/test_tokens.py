import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from steward.llm import tokens

TEXTS = [
    None, "", " ", "\n\n  x", "a", "It's THE end, isn't it?  \n\tNo!!  ", "déjà-vu Straße ÅNGSTRÖM ½ ²³ 1234",
    "日本語 and Ελληνικά ΣΑΣ", "é combining", "a\xa0b\x85c\x1cd", "<|endoftext|> <|startoftext|>", "x" * 5000,
    "x <|endoftext|> y", "a<|ENDOFTEXT|>b <|startoftext|", "if a <| b", "İstanbul ŒUVRE ŸES", "emoji 🙂 tail", "''s 'll ''", "tab\there\r\nthere",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_same_as_library(spark, sf, name, monkeypatch):
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    made, library = tokens.Encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kept in (10**6, 50):  # with and without forgetting
        monkeypatch.setattr(tokens, "WORDS_KEPT", kept)
        for _ in range(2):
            assert all(np.array_equal(a, b) for a, b in zip(made.encode(texts), want, strict=True))


def test_words_go_to_the_model_alone(monkeypatch):
    """Plain texts are put together from words; the library itself sees none of them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    made, library = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = ["One, two... one's 'three'", " ", "déjà-vu, déjà vu! 12.5%", None, "ÅNGSTRÖM's \"end\".", "a,b ,c '', ''s. 'll, x'll."]
    monkeypatch.setattr(made, "library", None)
    for most in (1, 1 << 22):  # a text at a time, and all together
        monkeypatch.setattr(tokens, "PIECES_CHARS", most)
        for text, ids in zip(texts, made.encode(texts), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_every_plain_character_beside_others():
    """Capitals among them whose small letters are not plain."""
    path = public_tokenizers.path("word_bpe_49k.json")
    made, library = tokens.Encoder(path), Tokenizer.from_file(path)
    plain = [chr(c) for c in range(0x250) if not tokens._PLAIN.search(chr(c))]
    texts = [t for c in plain for t in (c, f"a{c}b", f"1{c}2", f". {c}.{c}", f"'{c}", f"it's{c}'ll'{c}s", c * 5)]
    for text, ids in zip(texts, made.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
