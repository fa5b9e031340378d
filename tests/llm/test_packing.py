import zlib
from collections import defaultdict
from functools import partial

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import packing as K
from ledgerline.llm.encoding import library_ids
from ledgerline.llm.queries import QUERIES

from .conftest import SF, odd_texts

ENCODE = partial(library_ids, P.path("byte_bpe_50k.json"), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def pieces_of(doc_id, ids, capacity):
    at, out = 0, []
    for k, n in enumerate(K.cut_lengths(len(ids), capacity)):
        out.append((doc_id, k, at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes())))
        at += n
    assert at == len(ids)
    return out


def check(made, told, capacity):
    """Pieces are those told; sequences have no gap and hold no more than the capacity; the number of sequences."""
    key = lambda p: (p[0] is None, p)
    plain = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in made]
    assert sorted(((-1 if p[0] is None else p[0], *p[1:]) for p in plain)) == sorted(((-1 if p[0] is None else p[0], *p[1:]) for p in told)), key
    sequences = defaultdict(list)
    for r in made:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


def test_query_against_the_library(spark, texts, library):
    told = [p for i, t in texts.items() for p in pieces_of(i, library(t), 2_048)]
    n = check(QUERIES["op9_best_fit_packing"](spark, SF).collect(), told, 2_048)
    least = -(-sum(p[3] for p in told) // 2_048)
    assert n <= 1.02 * least + 1


@pytest.mark.parametrize("parts, sizes", [(40, (1, 100)), (70, (40, 60)), (30, (51, 60)), (1, (1, 100)), (90, (1, 8))])
def test_tree_over_many_partitions(spark, parts, sizes):
    rng = np.random.default_rng(parts)
    lengths = rng.integers(sizes[0], sizes[1] + 1, 3_000).tolist()
    rows = [(k, 0, 0, n, 0) for k, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(parts)
    n = check(K.pack_pieces(pieces, 100, task_pieces=-(-3_000 // parts)).collect(), rows, 100)
    alone = len(K.best_fit(np.array(lengths), 100)[1])
    assert alone <= n <= 1.1 * alone + 1  # a task sees some forty pieces only


@pytest.mark.parametrize("tasks", [1, 2, 4, 20])
@pytest.mark.parametrize("order", ["by doc_id", "by length", "mixed"])
def test_unlike_partitions(spark, tasks, order):
    """Files of one length each, as sources and dates make them; two lengths that only fit one with the other, and small ones."""
    rng = np.random.default_rng(7)
    lengths = [1_100] * 5_000 + [900] * 5_000 + rng.integers(10, 60, 5_000).tolist() + [2_000, 2_048] * 150
    rows = [(k, 0, 0, n, 0) for k, n in enumerate(lengths)]
    some = {"by doc_id": rows, "by length": sorted(rows, key=lambda r: r[3]), "mixed": [rows[k] for k in rng.permutation(len(rows))]}[order]
    pieces = spark.createDataFrame(some, "doc_id long, piece int, start long, length long, ids_crc32 long").coalesce(4)
    n = check(K.pack_pieces(pieces, 2_048, task_pieces=-(-len(rows) // tasks)).collect(), rows, 2_048)
    assert n <= 1.02 * len(K.best_fit(np.array(lengths), 2_048)[1])


def test_few_bins_go_on_where_there_are_too_many(spark):
    rng = np.random.default_rng(8)
    rows = [(k, 0, 0, int(n), 0) for k, n in enumerate(rng.integers(51, 61, 4_000))]  # no two go together
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert check(K.pack_pieces(pieces, 100, task_pieces=500, carry=60).collect(), rows, 100) == 4_000
    assert K.of_use(np.array([5] * 50 + [7] * 3), 100, 20).sum() == 13


def test_bins_of_use_are_all_that_the_next_level_takes():
    """Packing only the useful bins of eight tasks gives as many sequences as packing all of their bins."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        tasks = [K.best_fit(rng.integers(1, int(rng.integers(2, 100)), 200), 100)[1] for _ in range(8)]
        everything = len(K.best_fit(np.concatenate(tasks), 100)[1])
        useful = [K.of_use(full, 100) for full in tasks]
        rest = sum(int((~u).sum()) for u in useful)
        assert rest + len(K.best_fit(np.concatenate([f[u] for f, u in zip(tasks, useful)]), 100)[1]) == everything


def test_best_fit_takes_the_tightest_bin():
    bin_of, full = K.best_fit(np.array([50, 70, 30, 50, 20]), 100)
    assert full.tolist() == [100, 100, 20] and bin_of.tolist() == [1, 0, 0, 1, 2]


def test_odd_rows(odd_docs, no_docs, library):
    told = [p for i, t in odd_texts() for p in pieces_of(i, library(t), 2_048)]
    check(K.pack_documents(odd_docs, ENCODE, 0, 2_048).collect(), told, 2_048)
    assert K.pack_documents(no_docs, ENCODE, 0, 2_048).collect() == []


def test_what_is_held_back_is_packed_as_well(spark):
    """Tasks that may pass on a few bins only hold the others back; these still meet all others at the end."""
    rows = [(k, 0, 0, n, 0) for k, n in enumerate([60, 40] * 1_000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    assert check(K.pack_pieces(pieces, 100, task_pieces=100, carry=1).collect(), rows, 100) == 1_000


def test_counts_are_packed_like_their_items():
    rng = np.random.default_rng(10)
    for _ in range(100):
        sizes = rng.integers(1, int(rng.integers(2, 101)), int(rng.integers(1, 400)))
        values, counts = np.unique(sizes, return_counts=True)
        made = defaultdict(list)
        for n, first, last, b, each, start in K.fit_counts(dict(zip(values.tolist(), counts.tolist())), 100):
            for k in range(last - first):
                made[b + k // each].append((start + k % each * n, n))
        assert len(made) == len(K.best_fit(sizes, 100)[1]) and sorted(n for some in made.values() for _, n in some) == sorted(sizes.tolist())
        for some in made.values():
            some.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(some, some[1:])) and some[0][0] == 0 and sum(some[-1]) <= 100
