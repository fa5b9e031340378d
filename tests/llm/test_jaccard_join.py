import random

import pytest

from ledgerline.llm import jaccard_join as J
from ledgerline.llm import set_blocks as B
from ledgerline.llm import shingle_sets
from ledgerline.llm import shingle_sets as S

from .conftest import odd_texts, prose
from .test_near_dedup import copies, shingles


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(shingle_sets, "LEAST_BUCKETS", 2)


def brute(rows, percent=80):
    """doc_id -> (set size, least doc_id reachable), every pair compared; and the number of links."""
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    ids, root, links = sorted(sets), {i: i for i in sets}, 0

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                links += 1
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(s[-1]), top(i)) for i, s in sets.items()}, links


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(n, words, shared, seed):
    """n texts that have a part in common and the rest each for itself."""
    rng, common = random.Random(seed), prose(seed, shared)
    return [common + " " + " ".join(f"u{seed}x{k}x{j}" for j in range(words - shared + rng.randrange(3))) for k in range(n)]


def test_the_given_table(spark, documents, texts):
    told, links = brute(list(texts.items()))
    assert result(J.jaccard_groups(documents.repartition(3))) == told and links


@pytest.mark.parametrize(("few", "block"), [(32, 1_024), (0, 2)])
def test_chains_families_and_copies(spark, monkeypatch, few, block):
    monkeypatch.setattr(J, "FEW", few)
    monkeypatch.setattr(B, "BLOCK", block)
    same = prose(9, 120)
    texts = copies(120) + copies(60, 6) + [prose(k, 30) for k in range(100, 130)] + family(40, 100, 60, 11) + family(40, 100, 88, 12) + family(40, 100, 93, 13) + [same] * 30 + [same + " x", "a b c"] * 2
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    told, links = brute(rows)
    assert links > 300
    assert result(J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == told


@pytest.mark.parametrize("seed", range(2))
def test_random_near_texts_with_small_blocks(spark, monkeypatch, seed):
    monkeypatch.setattr(J, "FEW", 3)
    monkeypatch.setattr(B, "BLOCK", 4)
    monkeypatch.setattr(S, "BLOCK_DOCS", 7)
    rng, rows = random.Random(seed), []
    for k in range(220):
        words = prose(rng.choice([1, 2, 3]), 90).split()[: rng.randint(60, 90)]
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"n{k}"
        rows.append((k, " ".join(words)))
    told, links = brute(rows)
    assert links and result(J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == told


def test_shared_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_DOCS", 3)
    rows = list(enumerate(copies(25, 3) + family(10, 40, 30, 4) + [None, "", "one", "one", "two words"]))
    sets = {i: shingles(t) for i, t in rows}
    made = {r.doc_id: (r.n_shingles, r.shared) for r in S.shared_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert made == {i: (len(s), sum(any(x in o for j, o in sets.items() if j != i) for x in s)) for i, s in sets.items()}


def test_a_family_that_shares_a_part_sends_no_rows(spark):
    members = spark.range(40_000).selectExpr("7L as k", "id", "id as label", "96L as n", "56L as shared")
    assert B.cells(members, 75).count() == 0
    dense = spark.range(3_000).selectExpr("7L as k", "id", "id % 2 as label", "96L as n", "96L as shared")
    assert B.cells(dense, 75).count() > 0


def test_odd_rows(odd_docs, no_docs):
    made = [(r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_groups(odd_docs).collect()]
    assert len(made) == len(odd_texts())
    by_id = {r[0]: r for r in made if r[0] not in (6, 7, None)}
    assert by_id[1][1:] == (0, 1) and by_id[2][1:] == (0, 2) and by_id[4][1:] == (1, 4) and by_id[8][2] == 6 and by_id[16][2] == 15
    assert all(r[2] is None for r in made if r[0] is None) and sorted(r[2] for r in made if r[0] in (6, 7)) == [6, 6, 6, 7]
    assert J.jaccard_groups(no_docs).collect() == []
