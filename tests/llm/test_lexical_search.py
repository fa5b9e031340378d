import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import lexical_search as ls

from .conftest import SF, odd_texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(docs, items, top=10):
    """The definition, each document against each item."""
    found = [(i, TERM.findall((t or "").translate(CAPITALS))) for i, t in docs]
    found = [(i, Counter(w), len(w)) for i, w in found if w]
    n_docs, total = len(found), sum(n for _, _, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, tf, n in found:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * tf[t] // (1000 * tf[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(CAPITALS))) if t in tf)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item_id, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return out


def rows(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=repr)


def test_given_tables_against_the_definition(spark, documents, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain(texts.items(), [(r.item_id, r.text) for r in items.collect()])
    assert rows(ls.ranked(documents.repartition(5), items)) == sorted(want, key=repr) and len(want) > 50


def test_odd_rows_ties_and_repeats(spark, odd_docs):
    items = [(1, "One w1 w2 W3 东京 東京"), (1, "One w1 w2 W3 東京"), (2, None), (3, ""), (None, "licensed CC x́"), (5, "nowhere"), (6, " ".join(f"w{k}" for k in range(300)))]
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in items], "item_id long, text string, doc_id int, score string, rank int")
    docs = [(i, t) for i, t in odd_texts()]
    assert rows(ls.ranked(odd_docs, table)) == sorted(plain(docs, items), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_trees_of_any_shape_find_the_exact_best(seed, monkeypatch):
    rng, n_terms = random.Random(seed), 60
    weight = np.array([rng.choice([0, 5, 700, 9000]) for _ in range(n_terms)], dtype=np.int64)
    scale = np.sqrt(weight.astype(float))
    items = [np.array(sorted(rng.sample(range(n_terms), rng.randint(1, 12)))) for _ in range(30)]
    queries = np.zeros((n_terms, 30))
    for k, t in enumerate(items):
        queries[t, k] = scale[t]
    docs = [sorted(rng.sample(range(n_terms), rng.randint(1, 15))) for _ in range(200)]
    docs += [docs[0]] * 40  # ties
    values = [[rng.randint(1, 10**6) for _ in d] for d in docs]
    values[200:] = [values[0]] * 40
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    tree = ls.build(np.arange(len(docs)).astype(object), starts, np.concatenate(docs), np.concatenate(values), scale, queries, ls.term_groups(queries, 1 + 5 * seed), leaf=1 + seed * 3)
    own, scored = np.zeros(n_terms, dtype=np.int64), 0
    for k, t in enumerate(items):
        own[:] = 0
        own[t] = weight[t]
        best = []
        scored += ls.search(tree, k, own, best)
        exact = sorted(((-sum(own[t] * v for t, v in zip(d, vs)), i) for i, (d, vs) in enumerate(zip(docs, values))))
        assert sorted((-s, -i) for s, i in best) == [(s, i) for s, i in exact if s < 0][:10]
        for node, (lo, hi) in enumerate(tree.rows):
            for r in range(lo, hi):
                a, b = tree.starts[r], tree.starts[r + 1]
                assert (tree.values[a:b] * own[tree.terms[a:b]]).sum() <= tree.bounds[node, k]
    assert scored < len(docs) * len(items)


def test_items_in_several_blocks(spark, documents, texts, monkeypatch):
    monkeypatch.setattr(ls, "ITEMS", 7)
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain(texts.items(), [(r.item_id, r.text) for r in items.collect()])
    assert ls.item_blocks(items).select("block").distinct().count() >= 3
    assert rows(ls.ranked(documents, items)) == sorted(want, key=repr)


def test_empty_tables(spark, no_docs, documents):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ls.ranked(no_docs, items).count() == 0 and ls.ranked(documents, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def test_sql_gives_the_same_rows(spark):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    told = con.execute(entry.oracle_sql()["op12_lexical_search"]).fetchall()
    assert rows(entry.queries()["op12_lexical_search"](spark, SF)) == sorted(told, key=repr)
