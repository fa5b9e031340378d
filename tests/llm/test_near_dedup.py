import random
import re
from collections import defaultdict

import pytest

from ledgerline.llm import graph, near_dedup as N
from ledgerline.llm import set_blocks as B
from ledgerline.llm import shingle_sets
from ledgerline.llm.queries import QUERIES

from .conftest import SF, odd_texts, prose


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(shingle_sets, "LEAST_BUCKETS", 2)


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_id -> (set size, least doc_id reachable) for rows with distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    shared = defaultdict(int)
    for ids in holders.values():
        for x in range(len(ids)):
            for y in ids[x + 1 :]:
                shared[ids[x], y] += 1
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            links += 1
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {i: (len(s), top(i)) for i, s in sets.items()}, links


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def copies(n, seed=5):
    """Texts of 60 words, each with another few words than the one that it was copied from."""
    rng = random.Random(seed)
    made = [prose(seed, 60).split()]
    while len(made) < n:
        words = list(rng.choice(made[: 1 + len(made) // 2]))
        words[rng.randrange(60)] = f"n{len(made)}"
        made.append(words)
    return [" ".join(w) for w in made]


def test_query_against_brute_force(spark, texts):
    told, links = brute(list(texts.items()))
    made = QUERIES["op5_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made} == told and links
    assert all(r.kept == (r.doc_id == r.component_id) for r in made)


@pytest.mark.parametrize("block", [1_024, 8])
def test_chains_of_copies_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(B, "BLOCK", block)
    rows = list(enumerate(copies(150) + copies(60, 6) + [prose(k, 30) for k in range(100, 150)]))
    random.Random(1).shuffle(rows)
    told, links = brute(rows)
    assert links > 300
    assert result(N.groups(spark.createDataFrame(rows, "doc_id long, text string"))) == told


def test_recall_at_the_next_size(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    told, _ = brute([tuple(r) for r in docs.collect()])
    made = result(N.groups(docs))
    linked = [i for i, (_, c) in told.items() if c != i]
    assert sum(made[i] == told[i] for i in linked) >= 0.9 * len(linked) and len(linked) > 50
    assert all(made[i] == t for i, t in told.items() if t[1] == i and i not in {c for _, c in told.values()} - {i})


def test_odd_rows(odd_docs, no_docs):
    made = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.groups(odd_docs).collect()]
    assert len(made) == len(odd_texts())
    by_id = {r[0]: r for r in made if r[0] not in (6, 7, None)}
    assert by_id[1][1:] == (0, 1, True) and by_id[2][1:] == (0, 2, True) and by_id[4][1:] == (1, 4, True)
    assert by_id[8][2] == 6 and by_id[16][2] == 15 and not by_id[16][3]
    assert all(r[2] is None and r[3] for r in made if r[0] is None)
    assert N.groups(no_docs).collect() == []


def test_one_of_each_keeps_all_columns(odd_docs, no_docs):
    kept = N.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 6 in ids and 8 not in ids and 16 not in ids and 1 in ids
    assert N.one_of_each(no_docs).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 150), (7, 7), (300, 301), (301, 300)]
    made = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 160), 100), 200: 100, 300: 300, 301: 300}
    some = [(a, b) for b in range(50, 90) for a in (b % 7, b % 5, 3)]
    made = {r.id: r.component for r in graph.components(graph.contracted(spark.createDataFrame(some, "a long, b long"))).collect()}
    assert set(made.values()) == {0} and len(made) == 47


def test_hot_keys_are_spread(spark, monkeypatch):
    from ledgerline.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 3)
    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 50), (3, 51)], "k long, id long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k long, v string")
    assert common.hot_keys(left, "k") == [1]
    assert sorted(map(tuple, common.join_hot(left, right, "k", "id").collect())) == sorted([(1, k, "a") for k in range(50)] + [(2, 50, "b")])
