import zlib
from functools import partial

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import token_files as T
from ledgerline.llm.encoding import library_ids
from ledgerline.llm.queries import QUERIES

from .conftest import SF, odd_texts

ENCODE = partial(library_ids, P.path("word_bpe_49k.json"), None)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_query_against_the_library(spark, texts, library):
    made = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op6_token_files"](spark, SF).collect()}
    at = 0
    for i in sorted(texts):
        ids = library(texts[i])
        assert made[i] == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(made) == len(texts)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1_000, dtype=np.uint64).astype(np.uint32)
    packed = T.pack(ids, bits)
    assert len(packed) == 8 * -(-1_000 * bits // 64)
    for start, count in ((0, 1_000), (1, 1), (63, 130), (999, 1), (500, 0)):
        assert T.unpack(packed, bits, start, count).tolist() == ids[start : start + count].tolist()
    assert T.bits_for(49_408) == 16 and T.bits_for(1) == 1 and T.bits_for(65_537) == 17


def test_files_and_random_access(spark, texts, library):
    docs = spark.createDataFrame(sorted(texts.items())[:60], "doc_id long, text string").repartition(4)
    path = T.write_token_files(docs, ENCODE, vocabulary=49_408, end_id=1, block=700)
    told = [x for i in sorted(texts)[:60] for x in library(texts[i])]
    assert spark.read.parquet(f"{path}/blocks").count() > 20
    for start, count in ((0, 5), (690, 40), (3_000, 2_500), (len(told) - 3, 10), (0, len(told))):
        assert T.read_range(spark, path, start, count).tolist() == told[start : start + count]
    rows = T.read_documents(spark, path).orderBy("start").collect()
    assert [x for r in rows for x in r.ids] == told and [r.doc_id for r in rows] == sorted(texts)[:60]


def test_odd_rows(spark, odd_docs, no_docs, library):
    made = T.read_checksums(spark, T.write_token_files(odd_docs, ENCODE, 49_408, 1, block=500)).orderBy("start").collect()
    order = sorted(odd_texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    ids = [library(t) for _, t in order]
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in made] == [(i, len(x), crc(x)) for (i, _), x in zip(order, ids)]
    assert [r.start for r in made] == np.cumsum([0, *map(len, ids)])[:-1].tolist()
    assert T.read_checksums(spark, T.write_token_files(no_docs, ENCODE, 49_408, 1)).collect() == []
