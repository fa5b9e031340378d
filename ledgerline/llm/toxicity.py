"""Toxicity by cumulative-link ordinal regression over sparse word features.

The severity of a document is one of K ordered grades. One weight vector serves all thresholds:
P(grade > k) = sigmoid(w . x - t_k) with t_0 < t_1 < ..., and the score is the expected grade, the sum of
these probabilities. x holds log(1 + count) of each vocabulary word and is never scaled by length, so a long
text with the same words stays as severe.

Training takes a bounded sample of labelled rows (``sample`` of each class at most, those with the least hashes). Telling
words are those whose share of toxic rows, seen against the other rows, is far above chance; at most ``vocabulary`` of
them become features.

Labels only say toxic or not, so the order of the toxic rows comes from evidence beside the features: the telling
words are dealt to two views by a hash, and a toxic row's grade in one view is its rank by how many words of the other view it has, in
``grades`` equal parts. One likelihood is then maximised for all weights and all thresholds at once, over three rows for each
labelled text: its features with what the label says (grade 0, or some grade above 0), and twice the features of either view with the
grade that the other view gives; a view is half of the words by chance, so twice its features stand for the whole. A word so gets its severity
from the company it keeps, not from its own count. ``false_alarms`` sets the probability from which a row is called toxic, so that at most
this part of the other rows of the sample is, and leaves grades and severity as they are fitted.

Null and empty texts have no features and get the severity of the thresholds alone: what is left for
texts without a telling word. Copies of one text count once in the fit; if their labels differ, it is toxic. Labels that are null, or whose doc_id is null or not among the documents, are not used. With no label of one
kind there is nothing to learn, and every score is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_and_text, map_texts

SAMPLE, VOCABULARY, GRADES, FALSE_ALARMS = 1_500, 2_000, 3, 0.003
#: How much a row with a grade from the other view counts beside one with its label.
GRADED = 0.02
#: Lower-cases A-Z and makes every other ASCII character but digits a blank.
_LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER_WORDS).split()


@dataclass
class OrdinalModel:
    weights: dict[bytes, float]
    thresholds: list[float]
    operating: float = 0.5  # from this probability of a grade above 0 on a text is called toxic

    def score(self, text: bytes) -> list[float]:
        """P(grade > k) for each k."""
        get, at = self.weights.get, {}
        for w in words_of(text):
            if (v := get(w)) is not None:
                at[w] = (v, at.get(w, (v, 0))[1] + 1)
        s = sum(v * math.log1p(n) for v, n in at.values())
        return [1 / (1 + math.exp(min(50.0, max(-50.0, t - s)))) for t in self.thresholds]


def fit_ordinal(x: np.ndarray, grade: np.ndarray, k: int, ridge: float = 0.02, steps: int = 400, at_least: np.ndarray | None = None, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by maximum likelihood with a ridge, full-batch Adam. Of the rows ``at_least`` it is only known that
    their grade is no smaller; a row counts ``counts`` times."""
    n, d = x.shape
    share = np.full(n, 1 / n) if counts is None else counts / counts.sum()
    open_ended = np.zeros(n, dtype=bool) if at_least is None else at_least
    weights = np.zeros(d)
    cuts = np.concatenate([[1.0], np.zeros(max(0, k - 2))])  # first threshold, then logs of the gaps
    m, v = np.zeros(d + k - 1), np.zeros(d + k - 1)
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))
        s = x @ weights
        upper = np.where(open_ended, np.inf, np.concatenate([t, [np.inf]])[grade])
        lower = np.concatenate([[-np.inf], t])[grade]
        with np.errstate(over="ignore"):
            pu, pl = 1 / (1 + np.exp(s - upper)), 1 / (1 + np.exp(s - lower))
        p = np.maximum(pu - pl, 1e-12)
        du, dl = pu * (1 - pu) / p, pl * (1 - pl) / p
        gs = (du - dl) * share  # of the negative log likelihood by s
        gt = np.zeros(k - 1)
        for j in range(k - 1):
            gt[j] = -(du * share)[grade == j].sum() + (dl * share)[grade == j + 1].sum()
        tail = np.cumsum(gt[::-1])[::-1]
        gc = np.concatenate([tail[:1], tail[1:] * np.exp(cuts[1:])])
        g = np.concatenate([x.T @ gs + ridge * weights / max(1, d) ** 0.5, gc])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights, cuts = weights - move[:d], cuts - move[d:]
    return weights, np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])]))


def ranked(evidence: np.ndarray, parts: int) -> np.ndarray:
    """Grades 1 to ``parts`` by rank, equal parts; equal evidence has one grade, that of its middle rank."""
    order = np.sort(evidence)
    middle = (np.searchsorted(order, evidence, "left") + np.searchsorted(order, evidence, "right")) / (2 * max(1, len(order)))
    return 1 + np.minimum(parts - 1, (middle * parts).astype(np.int64))


def fit_rows(rows: list[tuple[bytes, int]], vocabulary: int = VOCABULARY, grades: int = GRADES, false_alarms: float = FALSE_ALARMS) -> OrdinalModel:
    k = grades + 1
    rows = sorted(dict(sorted(rows)).items())  # of copies of one text the last counts, a toxic one if there is any
    counts = [Counter(words_of(t)) for t, _ in rows]
    y = np.array([y for _, y in rows])
    n_bad, n_good = int(y.sum()), int((1 - y).sum()) if len(y) else 0
    if not n_bad or not n_good:
        return OrdinalModel({}, [50.0] * (k - 1))
    bad, good = Counter(), Counter()
    for c, label in zip(counts, y):
        (bad if label else good).update(c.keys())
    telling = {}
    for w, a in bad.items():
        b = good[w]
        pooled = (a + b) / (n_bad + n_good)
        z = (a / n_bad - b / n_good) / math.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / n_bad + 1 / n_good))
        odds = math.log((a + 0.5) / (n_bad + 1) * (n_good + 1) / (b + 0.5))
        if z > 3 and odds > 2 and a >= max(2, 0.01 * n_bad):
            telling[w] = z
    names = sorted(telling, key=lambda w: (-telling[w], w))[:vocabulary]
    column = {w: j for j, w in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    hits = np.zeros((len(rows), 2))
    view = {w: xxhash.xxh3_64_intdigest(w) & 1 for w in names}
    for i, c in enumerate(counts):
        for w in c.keys() & column.keys():
            x[i, column[w]] = math.log1p(c[w])
            hits[i, view[w]] += c[w]
    bad_rows, of = y == 1, np.array([view[w] for w in names], dtype=np.int64)
    features, known, censored, counts = [x], [bad_rows.astype(np.int64)], [bad_rows], [np.ones(len(rows))]
    for v in (0, 1):
        grade = np.zeros(len(rows), dtype=np.int64)
        grade[bad_rows] = ranked(hits[bad_rows, 1 - v], grades)
        features.append(2 * x * (of == v))
        known.append(grade)
        censored.append(np.zeros(len(rows), dtype=bool))
        counts.append(np.full(len(rows), GRADED))
    balance = np.where(bad_rows, 1 / n_bad, 1 / n_good)  # both labels count alike, whatever their share of the sample
    weights, thresholds = fit_ordinal(np.concatenate(features), np.concatenate(known), k, at_least=np.concatenate(censored), counts=np.concatenate(counts) * np.tile(balance, 3))
    clean = 1 / (1 + np.exp(np.clip(thresholds[0] - x[~bad_rows] @ weights, -50, 50)))
    operating = float(np.quantile(clean, 1 - false_alarms, method="higher")) + 1e-9
    return OrdinalModel({w: float(weights[j]) for w, j in column.items()}, thresholds.tolist(), operating)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most ``sample`` labelled rows of each class, those with the least hashes; their texts go to the driver."""
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    # four times the sample by the hash alone, of which the least hashes are taken: few rows are sorted, and the bound is sure
    chance = F.lit(0.0)
    for label, n in sizes.items():
        chance = F.when(F.col("toxic") == label, F.lit(min(1.0, 4 * sample / n))).otherwise(chance)
    least = lambda df, *by: df.withColumn("_rank", F.row_number().over(Window.partitionBy("toxic").orderBy(*by))).where(F.col("_rank") <= sample).drop("_rank")
    chosen = least(marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < chance * 1_000_003), F.xxhash64("doc_id"), "doc_id")
    # at most two times ``sample`` rows are broadcast; a doc_id may stand for many rows, so the bound is applied again
    rows = least(id_and_text(docs).join(F.broadcast(chosen), "doc_id"), F.xxhash64("doc_id", "text"), "text").select("text", "toxic")
    table = rows.toArrow()
    texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
    return fit_rows(sorted(zip(texts, table.column("toxic").to_pylist())))


def severity(docs: DataFrame, model: OrdinalModel, threshold: float | None = None) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic, grade (the likeliest side of each threshold) and toxic (p_toxic from ``threshold`` on,
    the model's operating point unless it is given)."""
    least = model.operating if threshold is None else threshold
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: list[bytes]) -> dict:
        over = [bound.value.score(t) for t in texts]
        return {
            "severity": [round(sum(p), 6) for p in over],
            "p_toxic": [round(p[0], 6) for p in over],
            "grade": [sum(q >= 0.5 for q in p) for p in over],
            "toxic": [p[0] >= least for p in over],
        }

    return map_texts(docs, "severity double, p_toxic double, grade int, toxic boolean", work)
