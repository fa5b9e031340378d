import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from ledgerline.llm import byte_bpe as B
from ledgerline.llm.queries import QUERIES

from .conftest import SF, odd_texts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={})


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_query_against_the_library(spark, texts, library):
    for r in QUERIES["op2_byte_bpe"](spark, SF).collect():
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(ids), hashlib.sha256(text.encode()).hexdigest())


def test_odd_strings(library):
    rng = random.Random(3)
    letters = "aaabbeé  \n\t'́東\U0001f600.,!0123456789sS\xa0\r\0"
    strings = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(4_000)] + ["a" * 5_000, "東" * 2_000, "'s't're", "  x  \n\n y"]
    made = B.encode_texts([s.encode() for s in strings], PATH, P.PATTERN)
    assert [m.tolist() for m in made] == [library.encode_ordinary(s) for s in strings]


def test_merging_by_rank_on_a_small_vocabulary():
    ranks = {bytes([c]): k for k, c in enumerate(b"abc")} | {b"ab": 3, b"bc": 4, b"abc": 5, b"aa": 6, b"aab": 7, b"ca": 8}
    bpe = B.BacktrackingBpe(ranks)

    def merged(piece):
        parts = [bytes([c]) for c in piece]
        if piece in ranks:
            return [ranks[piece]]
        while pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[p] for p in parts]

    rng = random.Random(1)
    for _ in range(3_000):
        piece = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
        ids = bpe.encode_piece(piece)
        assert ids == merged(piece) and bpe.decode(ids) == piece


def test_odd_rows(odd_docs, no_docs, library):
    made = B.round_trip(odd_docs, PATH, P.PATTERN).collect()
    told = sorted(((i is None, i or 0, digest(library.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_texts()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_sha256, r.decoded_sha256) for r in made) == told
    assert B.round_trip(no_docs, PATH, P.PATTERN).collect() == [] and B.encode_documents(no_docs, PATH, P.PATTERN).collect() == []
