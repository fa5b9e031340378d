import numpy as np

from ledgerline.llm import toxicity as X
from ledgerline.llm.queries import QUERIES

from .conftest import odd_texts, prose

SF = "/root/testdata/sf0.1"


def test_labelled_rows_that_were_not_learned(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = X.fit(docs, labels.where("doc_id % 2 = 0"))
    made = {r.doc_id: r for r in X.severity(docs, model).collect()}
    rest = labels.where("doc_id % 2 = 1").collect()
    caught = [made[r.doc_id].toxic for r in rest if r.toxic == 1]
    assert np.mean(caught) > 0.87 and np.mean([made[r.doc_id].toxic for r in rest if r.toxic == 0]) < 0.02
    grades = [made[r.doc_id].grade for r in rest if r.toxic == 1]
    assert set(grades) >= {1, 2, 3}


def test_query_covers_every_row(spark):
    made = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(made) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert all(0 <= r.severity <= 3 and 0 <= r.p_toxic <= 1 for r in made)


def test_ordinal_fit_finds_planted_thresholds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6_000, 3))
    s = x @ np.array([1.5, -1.0, 0.0])
    noisy = s + rng.logistic(size=len(s))
    grade = (noisy > -1).astype(int) + (noisy > 0.5) + (noisy > 2)
    w, t = X.fit_ordinal(x, grade, 4, ridge=0.0, steps=1_500)
    assert np.allclose(w, [1.5, -1.0, 0.0], atol=0.15) and np.allclose(t, [-1, 0.5, 2], atol=0.15)


def test_sample_bound(spark):
    docs = spark.createDataFrame([(k % 40, f"bad{k % 3} worse {prose(k, 10)}" if k % 2 else prose(k, 12)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    seen = []
    fit_rows, X.fit_rows = X.fit_rows, lambda rows: seen.append(rows) or fit_rows(rows)
    try:
        X.fit(docs, labels, sample=30)
    finally:
        X.fit_rows = fit_rows
    assert {y: sum(v == y for _, v in seen[0]) for y in (0, 1)} == {0: 30, 1: 30}


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (999, 1, 0), (9, 1, 0)], "doc_id long, toxic int, n int")
    model = X.fit(odd_docs, labels)
    made = X.severity(odd_docs, model).collect()
    assert len(made) == len(odd_texts()) and X.severity(no_docs, X.fit(no_docs, labels)).collect() == []
    nothing = X.fit(odd_docs, labels.where("toxic = 0"))
    assert {r.severity for r in X.severity(odd_docs, nothing).collect()} == {0.0}


def test_the_joint_fit_against_a_plain_likelihood():
    """No step away from the fitted weights and thresholds makes the likelihood, written out row by row, larger."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 2))
    noisy = x @ np.array([1.0, 0.5]) + rng.logistic(size=400)
    grade = (noisy > -0.5).astype(int) + (noisy > 0.7) + (noisy > 1.5)
    loose, counts = rng.random(400) < 0.3, rng.choice([0.5, 1.0, 3.0], 400)
    known = np.where(loose & (grade > 0), 1, grade)
    loose &= grade > 0

    def likelihood(w, t):
        total = 0.0
        for row, g, some, n in zip(x, known, loose, counts):
            below = lambda k: 1 / (1 + np.exp(row @ w - t[k]))  # noqa: E731  P(grade <= k)
            low = below(g - 1) if g else 0.0
            total += n * np.log((1.0 if some or g == 3 else below(g)) - low)
        return total / counts.sum()

    w, t = X.fit_ordinal(x, known, 4, ridge=0.0, steps=4_000, at_least=loose, counts=counts)
    best = likelihood(w, t)
    for j in range(5):
        for step in (-0.05, 0.05):
            near = np.concatenate([w, t])
            near[j] += step
            assert likelihood(near[:2], near[2:]) < best


def test_labels_of_copies_and_the_operating_point():
    rows = [(b"vile slur", 1)] * 30 + [(f"vile slur {k}".encode(), 1) for k in range(30)] + [(f"kind word {k}".encode(), 0) for k in range(200)] + [(b"vile slur", 0)]
    model = X.fit_rows(rows)
    assert model.score(b"vile slur")[0] >= model.operating > model.score(b"kind word 3")[0]
    assert X.fit_rows(rows[::-1]) == model
