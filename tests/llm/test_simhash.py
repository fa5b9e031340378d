import hashlib

import pytest

from ledgerline.llm import simhash as S
from ledgerline.llm.queries import QUERIES

from .conftest import SF, odd_texts, prose


def test_query_against_brute_force(spark, texts):
    made = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, SF).collect()}
    ids = sorted(texts)
    assert sorted(made) == ids
    marks = {i: S.fingerprint((texts[i] or "").encode()) for i in ids}
    for i, j in zip(ids, ids[1:] + ids[:1]):
        a, b = texts[i] or "", texts[j] or ""
        k = len(a) // 4
        changed = (a[: len(a) - k] + b[:k]).encode()
        r = made[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(a), hashlib.sha256(changed).hexdigest(), S.as_text(marks[i]))
        assert r.edited_fingerprint == S.as_text(S.fingerprint(changed)) and r.near_next == S.likeness(marks[i], marks[j])
        near = sum((marks[i] ^ m).bit_count() <= S.RADIUS for x, m in marks.items() if x != i)
        assert r.n_near == (near if i % 50 == 0 else None)
    assert sum(r.near_edited for r in made.values()) > sum(r.near_next for r in made.values()) + len(ids) / 4


@pytest.mark.parametrize("radius, part", [(0, 4_096), (3, 7), (9, 4_096), (15, 50)])
def test_search_finds_all_within_the_radius(spark, monkeypatch, radius, part):
    monkeypatch.setattr(S, "PART", part)
    base = prose(5, 200).split()
    texts = [" ".join(w if (k * 31 + p) % 40 else f"n{k}" for p, w in enumerate(base)) for k in range(60)] + [prose(k, 30) for k in range(40)] + [" ".join(base)] * 3 + ["", ""]
    marks = [(k, S.as_text(S.fingerprint(t.encode()))) for k, t in enumerate(texts)]
    df = spark.createDataFrame(marks, "doc_id long, fingerprint string")
    made = {r.doc_id: r.n_near for r in S.within(df, df.where("doc_id % 3 = 0"), radius).collect()}
    ints = [int(m, 16) for _, m in marks]
    assert made == {i: sum((ints[i] ^ x).bit_count() <= radius for x in ints) - 1 for i in range(0, len(texts), 3)}
    assert any(made.values())


def test_likeness_ends():
    assert S.likeness(0, 0) == 1 and S.likeness(0, (1 << 64) - 1) == 0 and S.likeness(0, (1 << 128) - 1) == 0


def test_odd_rows(odd_docs, no_docs):
    made = S.searched(odd_docs).collect()
    assert len(made) == len(odd_texts()) and S.searched(no_docs).collect() == []
    empty = [r for r in made if r.n_chars == 0]
    assert {r.fingerprint for r in empty} == {"0" * 32} and sum(r.doc_id is None for r in made) == 2
    order = sorted(odd_texts(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    told = sorted(hashlib.sha256(((a or "")[: len(a or "") - len(a or "") // 4] + (b or "")[: len(a or "") // 4]).encode()).hexdigest() for (_, a), (_, b) in zip(order, order[1:] + order[:1]))
    assert sorted(r.edited_sha256 for r in made) == told


def test_a_single_document_follows_itself(spark):
    (r,) = S.fingerprints(spark.createDataFrame([(3, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert r.near_next == 1 and r.n_chars == 15
