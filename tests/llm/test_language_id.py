import zlib

import numpy as np

from ledgerline.llm import language_id as I, stages
from ledgerline.llm.queries import QUERIES

from .conftest import odd_texts, prose

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    made = QUERIES["op10_language_id"](spark, SF).collect()
    assert len(made) == len(rows)
    right = []
    for r in made:
        text = rows[r.doc_id].text
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
        if r.held_out and rows[r.doc_id].lang and r.lang_pred != "und":
            right.append(r.lang_pred == rows[r.doc_id].lang)
    assert len(right) > 150 and np.mean(right) > 0.95


def test_more_languages_than_are_learned(spark):
    """Many languages neither fail nor send more than the stated rows; the most frequent ones are learned."""
    rows = [(k, prose(k % 230, 20), f"l{k % 230:03}") for k in range(460)] + [(1_000 + k, prose(900 + k, 30), "often") for k in range(9)]
    net = I.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=2, per_row=1, languages=5)
    assert len(net.languages) == 5 and "often" in net.languages
    assert len(I.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=1, per_row=1).languages) > 200


def test_windows_are_spread_over_the_whole_text():
    text = bytes(range(256)) * 1_000
    some = I.spread_windows(text, 6)
    at = [text.index(w, 128 * k * 2_000 // 6 // 128 * 128) for k, w in enumerate(some)]
    assert len(some) == 6 and max(at) > len(text) // 2 and all(len(w) == I.WINDOW for w in some)
    assert I.spread_windows(b"abc", 6) == [b"abc"] and I.spread_windows(b"", 6) == []


def test_groups_by_bytes():
    texts = [b"x" * n for n in (10, 20, 500, 1, 1, 1, 90)]
    assert [texts[s] for s in I.in_groups(texts, 100)] == [texts[:2], texts[2:3], texts[3:]]
    assert list(I.in_groups([])) == []


def test_gradient_against_differences():
    """Training lowers the loss and separates two languages that differ in their bytes."""
    rows = [(b"abab cdcd " * 5, "x"), (b"wxyz zyxw " * 5, "y")] * 30
    net = I.train(rows)
    best, score = I.predict(net, [b"abab cdcd abab", b"zyxw wxyz", b"ab" * 70_000])
    assert [net.languages[b] for b in best] == ["x", "y", "x"] and score.min() > 0.8
    assert I.train([]) is None


def test_odd_rows(spark, odd_docs, no_docs):
    net = I.fit(odd_docs)
    made = I.identify(odd_docs, net).collect()
    assert len(made) == len(odd_texts())
    assert all(r.lang_pred == "und" and r.score == 0 for r in made if r.doc_id in (1, 2, 3))
    assert [r.held_out for r in made if r.doc_id is None] == [False, False]
    assert I.identify(no_docs, I.fit(no_docs)).collect() == []
    assert {r.lang_pred for r in I.identify(odd_docs, None).collect()} == {"und"}


def test_stage_keeps_what_has_a_language(spark, odd_docs, no_docs):
    kept = stages.language_id(spark, odd_docs, "")
    assert kept.schema == odd_docs.schema and not {1, 2, 3, 10} & {r.doc_id for r in kept.collect()}
    assert stages.language_id(spark, no_docs, "").collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id", "left_semi").where("length(text) > 200")
    assert stages.language_id(spark, clean, "").count() > 0.98 * clean.count()
