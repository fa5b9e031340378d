import random
import re

from ledgerline.llm import license_scan as L
from ledgerline.llm.queries import QUERIES

from .conftest import SF, odd_texts

PHRASES = {("under", "the", "mit", "license"): "mit", ("apache", "license", "version", "2"): "apache-2", ("cc", "by", "nc"): "cc-by-nc"}


def brute(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at = [(k, label) for k in range(len(words)) for p, label in PHRASES.items() if tuple(words[k : k + len(p)]) == p]
    return len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))


BASE = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_query_against_brute_force(spark, texts):
    made = QUERIES["op7_license_scan"](spark, SF).collect()
    assert any(r.n_base for r in made)
    for r in made:
        assert tuple(r[c] for c in BASE) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def labels(text):
    return {d.label for d in L.scan_text(text.encode())[2]}


def test_rules():
    assert labels("License: MIT") == {"mit"} and labels("SPDX-License-Identifier: GPL-3.0-or-later") == {"gpl-3"}
    assert labels("Licensed under the GPL.") == {"gpl"} and labels("GNU GPL version 3 license") == {"gpl-3"} and labels("a BSD license") == {"bsd"}
    assert labels("released under the terms of the Mozilla Public License, v. 2.0") == {"mpl-2"}
    assert labels("Permission is hereby granted, free of charge, to any person obtaining a copy of this") == {"mit"}
    assert labels("cc by nc") == {"cc-by-nc"} and labels("CC BY-NC-SA 4.0 license") == {"cc-by-nc", "cc-by-nc-sa"}  # the phrase always stays
    assert labels("the mit of licenses and a general public") == set() and labels("") == set()
    assert len(L.SENTENCES) > 60 and len(L.default_rules()) > 400
    for _, pattern, keyword in L.SENTENCES:  # a keyword that a match need not hold would lose it
        assert keyword in re.sub(r"\(\?:|\)|\?|\[cs\]", lambda m: {"[cs]": "s"}.get(m[0], ""), pattern) or re.search(keyword.replace("s", "[cs]"), pattern) or keyword.split()[0] in pattern


def slow(found):
    kept = []
    for d in sorted(set(found), key=lambda d: (d.priority, d.first - d.last, d.first, d.label)):
        if d.priority == 0 or not any(k.first <= d.first and d.last <= k.last for k in kept):
            kept.append(d)
    return sorted(kept, key=lambda d: (d.first, d.last, d.label))


def test_suppression_against_brute_force():
    rng = random.Random(4)
    for _ in range(2_000):
        found = [L.Detection(rng.choice("abc"), f := rng.randrange(30), f + rng.randrange(12), rng.randrange(4), 0.5) for _ in range(rng.randrange(14))]
        assert L.resolve(found) == slow(found)


def test_a_long_text_with_many_places():
    text = b"licensed under the mit license, x " * 30_000
    n, base, kept = L.scan_text(text)
    assert (n, len(base), base[-1].first) == (180_000, 30_000, 6 * 29_999 + 1) and len(kept) == 60_000


def test_odd_rows(odd_docs, no_docs):
    made = sorted(((r.doc_id is None, r.doc_id or 0), *(str(r[c]) for c in BASE)) for r in L.scan(odd_docs).collect())
    assert made == sorted(((i is None, i or 0), *map(str, brute(t))) for i, t in odd_texts())
    assert L.scan(no_docs).collect() == []
