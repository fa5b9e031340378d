import hashlib
import random
import re

import pytest

from ledgerline.llm import stages, substring_dedup as S
from ledgerline.llm.queries import QUERIES

from .conftest import SF, odd_texts, prose


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute(rows, window=13):
    """doc_id -> words left, for rows with distinct ids."""
    first = {}
    words = {i: words_of(t) for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = [x for x, g in zip(w, gone) if not g]
    return words, out


def compare(made, rows, window=13):
    words, left = brute(rows, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in made} == {i: (len(words[i]), len(words[i]) - len(left[i]), hashlib.sha256(b" ".join(left[i])).hexdigest()) for i in words}
    return sum(len(words[i]) - len(left[i]) for i in words)


def test_query_against_brute_force(spark, texts):
    assert compare(QUERIES["op4_substring_dedup"](spark, SF).collect(), list(texts.items())) > 0


def passages(seed=3):
    """Texts that share passages of 5 to 40 words, so that candidates are left and lost at every level."""
    rng, made = random.Random(seed), []
    shared = [prose(k, n) for k, n in enumerate((5, 8, 12, 13, 14, 20, 26, 40))]
    for k in range(80):
        made.append(" ".join(x for _ in range(4) for x in (prose(1_000 + rng.randrange(10**6), rng.randrange(3, 30)), rng.choice(shared))))
    return list(enumerate(made)) + [(100, made[7]), (101, made[7])]


@pytest.mark.parametrize("window, start", [(13, 7), (13, 3), (13, 4), (8, 2), (13, 13), (5, 7)])
def test_levels(spark, window, start):
    rows = passages()
    made = S.removals(spark.createDataFrame(rows, "doc_id long, text string"), window, start).collect()
    assert compare(made, rows, window) > 500
    assert S.levels(13, 3) == [3, 6, 12, 13] and S.levels(13, 7) == [7, 13]


def test_stops_when_no_candidate_survives(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(S, "stored", lambda df, name, f=S.stored: seen.append(name) or f(df, name))
    rows = [(k, prose(9_000 + k, 60)) for k in range(20)]
    compare(S.removals(spark.createDataFrame(rows, "doc_id long, text string"), 13, 3).collect(), rows)
    assert "windows-6" in seen and "windows-13" not in seen


def test_hot_windows_count_as_repeated(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 1)
    monkeypatch.setattr(S, "HOT_SHARE", 200)
    rows = [(k, prose(77, 40) + " " + prose(500 + k, 30)) for k in range(60)] + [(70, prose(77, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert 0 < len(S._often(docs, 13, 7)) < 200
    assert compare(S.removals(docs).collect(), rows) >= 60 * 40


def test_odd_rows(odd_docs, no_docs):
    made = S.removals(odd_docs).collect()
    assert len(made) == len(odd_texts()) and S.removals(no_docs).collect() == []
    by_id = {}
    for r in made:
        by_id.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert by_id[1] == [(0, 0)] and by_id[4] == [(1, 0)] and by_id[8][0][1] >= 300
    assert by_id[6] == [(300, 0), (300, 0)]  # rows of one doc_id are not smaller than each other
    assert (300, 300) in by_id[None] and by_id[15] == [(40, 0)] and by_id[16] == [(40, 40)]


def test_stage_keeps_columns_and_rows_with_words(spark, odd_docs, no_docs):
    kept = stages.substring_dedup(spark, odd_docs, "")
    assert kept.schema == odd_docs.schema
    rows = kept.collect()
    assert not any(r.doc_id == 16 for r in rows) and sum(r.doc_id == 6 for r in rows) == 2
    assert {r.doc_id: r.text for r in rows}[9].split() != prose(1, 300).split() and sum(r.doc_id is None for r in rows) == 1
    assert stages.substring_dedup(spark, no_docs, "").collect() == []
