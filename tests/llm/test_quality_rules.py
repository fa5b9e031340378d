import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import quality_rules as Q, stages
from ledgerline.llm.queries import QUERIES

from .conftest import SF, odd_texts


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(grams)
    covered = {k + j for k, g in enumerate(grams) if counts[g] > 1 for j in range(5)}
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
    return (*base, base[0] < 10 or 100 * base[4] > 20 * base[0])


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_query_against_brute_force(spark, texts):
    for r in QUERIES["op1_quality_rules"](spark, SF).collect():
        assert tuple(r[c] for c in BASE) == brute(texts[r.doc_id])
        assert not (r.base_failed and r.kept) and r.kept == (not r.base_failed and r.p_good >= 0.5)


def test_labelled_quality(spark):
    """Hardly any good document goes that passes the base rule, most bad ones go."""
    sf = "/root/testdata/sf0.01"
    made = {r.doc_id: r for r in QUERIES["op1_quality_rules"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [made[r.doc_id].kept for r in labels if r.quality == 1 and not made[r.doc_id].base_failed]
    bad = [made[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


@pytest.mark.parametrize("weight", [0.1, 0.003, 0.0003])
def test_which_documents_are_kept_does_not_hang_on_the_belief(spark, weight):
    rows = Q.measure(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("pattern").count().collect()
    names = list(Q.RULES)
    patterns = sorted((tuple(r["pattern"] // 3**k % 3 - 1 for k in range(len(names))), r["count"]) for r in rows)

    def kept(model):
        score = lambda p: sum(model.weights(n)[v > 0] if v else 0.0 for n, v in zip(names, p)) + np.log(model.prior / (1 - model.prior))
        return {p for p, _ in patterns if score(p) >= 0}

    told = kept(Q.fit_patterns(patterns, names))
    now = kept(Q.fit_patterns(patterns, names, belief_weight=weight))
    assert sum(n for p, n in patterns if p in told ^ now) <= 0.01 * sum(n for _, n in patterns)


def test_em_finds_planted_accuracies():
    rng, names = random.Random(2), ["a", "b", "c", "d"]
    rates = {"a": (0.98, 0.7), "b": (0.95, 0.5), "c": (0.99, 0.3), "d": (0.9, 0.6)}
    counts = Counter()
    for _ in range(60_000):
        good = rng.random() < 0.8
        counts[tuple((1 if good else -1) * (1 if rng.random() < rates[n][0 if good else 1] else -1) if rng.random() < 0.9 else 0 for n in names)] += 1
    model = Q.fit_patterns(sorted(counts.items()), names)
    assert abs(model.prior - 0.8) < 0.03
    for n in names:
        assert np.allclose(model.accuracy[n], rates[n], atol=0.06)


def test_odd_rows(spark, odd_docs, no_docs):
    made = Q.quality(odd_docs).collect()
    told = Counter((i, *brute(t)) for i, t in odd_texts())
    assert Counter((r.doc_id, *(r[c] for c in BASE)) for r in made) == told
    assert Q.quality(no_docs).collect() == []
    kept = stages.quality_rules(spark, odd_docs, "")
    assert kept.schema == odd_docs.schema and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in made if r.kept)
    assert stages.quality_rules(spark, no_docs, "").collect() == []
