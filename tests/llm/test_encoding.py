import random
from array import array

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import encoding as E

FILES = [("word_bpe_49k.json", None), ("byte_bpe_50k.json", P.PATTERN)]


def same_as_library(name, pattern, texts):
    library = Tokenizer.from_file(P.path(name))
    made = [array("I", ids).tolist() for ids in E.library_ids(P.path(name), pattern, [t.encode() for t in texts])]
    told = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert made == told, [t for t, a, b in zip(texts, made, told) if a != b][:5]


@pytest.mark.parametrize("name, pattern", FILES)
def test_special_tokens_in_texts(name, pattern):
    texts = ["ab <|endoftext|> cd", "ab  <|endoftext|>\n\ncd.", "<|endoftext|>", "x<|startoftext|>y<|endoftext|>.", "One <|ENDOFTEXT|> two.", "<|endoftext|", "A plain text. Twice, a plain text."]
    same_as_library(name, pattern, texts)


@pytest.mark.parametrize("name, pattern", FILES)
def test_accents_in_two_characters(name, pattern):
    texts = ["J̌", "T̈x Plain", "H̱.", "İ. İ, b", "A क़.", "A שׁ.", "ÉCOLE École, CafÉ. CAFE", "A ́B\ńC", "J̌ <|ENDOFTEXT|> J̌", "J̌ <|endoftext|> T̈x", "Straße × ÷ ÆØ æøÿ"]
    same_as_library(name, pattern, texts)


@pytest.mark.parametrize("name, pattern", FILES)
def test_odd_strings(name, pattern):
    """Random strings of letters, marks, white space of many kinds, separators that the encoder uses itself, and special tokens."""
    rng = random.Random(8)
    pieces = [*"aAbBeEzZ éÉß́̌东\U0001f600.,!~ŒİǅʰⅠ \n\t\r\xa0\0\x1f 　0129'", " ", " ", "\n", ". ", ", ", "the", "The", " word", "'s", "'S", "~ ", " ~ ", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(12_000)]
    same_as_library(name, pattern, texts + ["", " ", "\n", "~", " ~ ", "a" * 3_000, "é" * 2_000, "ab " * 5_000])


def test_table_forgets_and_groups(monkeypatch):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    table = E.ChunkTable(lambda cs: [array("I", library.encode(c, add_special_tokens=False).ids).tobytes() for c in cs], None, limit=60, longest=8)
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(30)) for _ in range(60)]
    for each in (50, 500, 10**6):
        assert [array("I", x).tolist() for x in table.many(texts, each)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(table.young) <= 60 and all(len(c) <= 8 for c in table.young)
