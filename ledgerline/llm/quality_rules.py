"""Quality rules as weak supervision: rules vote good, bad or abstain; EM weighs them; the posterior decides.

``measure`` counts what the rules look at, one row per document. ``fit`` groups the votes into patterns
(at most 3^rules of them, whatever the size of the corpus), and estimates by expectation-maximisation the
share of good documents and, for each rule, how often its vote is right. ``judge`` turns each pattern
into the posterior probability that the document is good.

Null, empty and white-space texts have no words: all counts are 0 and the base rule fails. Repeated rows, and rows with
the same or no doc_id, are judged each by its text. With no documents the model stays at its start values. Memory is in proportion to the longest
text, some ten bytes for each of its bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, map_texts, written
from .hashing import grams, hash_words

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
_LONE = [bytes([s]) for s in SYMBOLS]
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_letters long, n_digits long, n_lone long"
_UPPER, _LOWER, _DIGIT = (bytes(range(a, b + 1)) for a, b in ((65, 90), (97, 122), (48, 57)))
_NOT = {name: bytes(set(range(256)) - set(chars)) for name, chars in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("cont", bytes(range(128, 192))), ("ascii", bytes(range(128))))}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the list. Windows of equal hash are compared word by word."""
    n = len(words) - window + 1
    if n < 2 or len(set(words)) == len(words):
        return 0
    h = grams(hash_words(words), window)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    seen: dict[tuple, list[int]] = {}
    for i in order[np.append(same, False) | np.append(False, same)].tolist():
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for at in seen.values():
        if len(at) > 1:
            covered[at] += 1
            covered[np.array(at) + window] -= 1
    return int((np.cumsum(covered)[:-1] > 0).sum())


def count_text(text: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS. Letters are those of ASCII and all characters beyond it."""
    words = text.split()
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    chars = len(joined) - len(joined.translate(None, _NOT["cont"]))
    upper = len(joined.translate(None, _NOT["upper"]))
    return (
        len(words),
        chars,
        sum(text.count(s) for s in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        upper,
        upper + len(joined.translate(None, _NOT["lower"])) + chars - len(joined.translate(None, _NOT["ascii"])),
        len(joined.translate(None, _NOT["digit"])),
        sum(words.count(s) for s in _LONE),
    )


def count_texts(texts: list[bytes]) -> dict:
    """The counts of many texts, and the votes of all rules on each as one number: its digits to the base 3 are the votes plus 1."""
    names = [c.split()[0] for c in COUNTS.split(", ")]
    rows = [count_text(t) for t in texts]
    counts = {n: np.array([r[k] for r in rows], dtype=np.int64) for k, n in enumerate(names)}
    pattern = np.zeros(len(texts), dtype=np.int64)
    for k, vote in enumerate(RULES.values()):
        pattern += (vote(counts) + 1) * 3**k
    return {**counts, "pattern": pattern}


def _share(part: np.ndarray, of: np.ndarray) -> np.ndarray:
    return part / np.maximum(of, 1)


def _vote(share: np.ndarray, good: float, bad: float, says: np.ndarray) -> np.ndarray:
    """+1 where the share is at most ``good``, -1 where it is over ``bad``, else 0 (abstain), and 0 where the rule has nothing to say."""
    return np.where(says, np.where(share <= good, 1, np.where(share > bad, -1, 0)), 0)


def _word_length(c: dict) -> np.ndarray:
    mean = _share(c["word_chars"], c["n_words"])
    return np.where(c["n_words"] == 0, 0, np.where((mean >= 3) & (mean <= 11), 1, np.where((mean < 2) | (mean > 18), -1, 0)))


#: Rule name -> its votes over the counts. Each looks at evidence of its own, as their votes are taken to be independent within a class.
RULES: dict[str, Callable[[dict], np.ndarray]] = {
    "symbols": lambda c: _vote(_share(c["n_symbols"], c["n_words"]), 0.05, 0.25, c["n_words"] > 0),
    "capitals": lambda c: _vote(_share(c["n_upper"], c["n_letters"]), 0.2, 0.5, c["n_letters"] >= 40),
    "word_length": _word_length,
    "repeats": lambda c: _vote(_share(c["n_repeat_words"], c["n_words"]), 0.05, 0.2, c["n_words"] > 0),
    "line_copies": lambda c: _vote(_share(c["n_dup_lines"], c["n_lines"]), 0.2, 0.5, c["n_lines"] >= 4),
    "lone_symbols": lambda c: _vote(_share(c["n_lone"], c["n_words"]), 0.02, 0.15, c["n_words"] > 0),
    "length": lambda c: np.where(c["n_words"] < 10, -1, np.where(c["n_words"] >= 40, 1, 0)),
    "letters": lambda c: _vote(1 - _share(c["n_letters"], c["word_chars"]), 0.12, 0.25, c["word_chars"] >= 200),
}


def measure(docs: DataFrame) -> DataFrame:
    """The counts of every document, and the pattern of the rules' votes on it."""
    return map_texts(docs, COUNTS + ", pattern long", count_texts)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass
class QualityModel:
    """Share of good documents, and each rule's accuracy: how often its vote is right on good and on bad documents."""

    prior: float = 0.9
    accuracy: dict[str, tuple[float, float]] = field(default_factory=dict)

    def weights(self, rule: str) -> tuple[float, float]:
        """What a vote for bad, and one for good, adds to the log odds of good.

        A vote for good never counts against a document, nor a vote for bad in its favour: that fixes which of
        the two hidden classes is the good one. To abstain says nothing.
        """
        good, bad = self.accuracy[rule]
        return min(0.0, math.log((1 - good) / bad)), max(0.0, math.log(good / (1 - bad)))


#: A bad document is bad in one way, so most rules find it good. How often a vote is taken to be right on good and on bad
#: documents before any data, and what share of all rows that belief weighs: it keeps rates off 0 and 1 and the classes in their places;
#: the tests show that which documents are kept doesn't hang on it.
_BELIEF, _BELIEF_WEIGHT = (0.995, 0.15), 0.003


def fit_patterns(patterns: list[tuple[tuple[int, ...], int]], rules: list[str], rounds: int = 300, belief_weight: float = _BELIEF_WEIGHT) -> QualityModel:
    """Expectation-maximisation over counted vote patterns, from a common belief about all rules."""
    model = QualityModel(0.9, dict.fromkeys(rules, _BELIEF))
    votes = np.array([p for p, _ in patterns], dtype=int).reshape(-1, len(rules))
    n = np.array([c for _, c in patterns], dtype=float)
    for _ in range(rounds if len(patterns) else 0):
        w = np.array([model.weights(r) for r in rules])
        logit = math.log(model.prior / (1 - model.prior)) + ((votes < 0) * w[:, 0] + (votes > 0) * w[:, 1]).sum(1)
        p = 1 / (1 + np.exp(-logit))
        rates = []
        for q, vote, belief in ((p, 1, _BELIEF[0]), (1 - p, -1, _BELIEF[1])):
            soft = belief_weight * n.sum()
            right, cast = ((n * q)[:, None] * (votes == vote)).sum(0), ((n * q)[:, None] * (votes != 0)).sum(0)
            rates.append((right + belief * soft) / (cast + soft))
        new = QualityModel(float(np.clip((n * p).sum() / n.sum(), 0.02, 0.98)), {r: (float(a), float(b)) for r, a, b in zip(rules, *rates)})
        moved = max(abs(new.prior - model.prior), *(abs(x - y) for r in rules for x, y in zip(new.accuracy[r], model.accuracy[r])))
        model = new
        if moved < 1e-8:
            break
    return model


def fit(counts: DataFrame) -> QualityModel:
    """Fit on the votes on all documents; the driver gets at most 3^rules pattern rows."""
    rows = counts.groupBy("pattern").count().collect()
    patterns = sorted((tuple(r["pattern"] // 3**k % 3 - 1 for k in range(len(RULES))), r["count"]) for r in rows)
    return fit_patterns(patterns, list(RULES))


def judge(counts: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, p_good and kept. A document that fails the base rule is never kept."""
    logit = F.lit(math.log(model.prior / (1 - model.prior)))
    for k, r in enumerate(RULES):
        bad, good = model.weights(r)
        vote = F.expr(f"pattern div {3**k} % 3 - 1")
        logit = logit + F.when(vote > 0, F.lit(good)).when(vote < 0, F.lit(bad)).otherwise(F.lit(0.0))
    p = 1 / (1 + F.exp(-logit))
    return counts.withColumn("base_failed", base_failed()).withColumn("p_good", p).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def quality(docs: DataFrame) -> DataFrame:
    """Measure, fit and judge; the counts are written once, so texts are read once."""
    counts = written(measure(docs), "quality-counts")
    return judge(counts, fit(counts))


def kept_documents(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, all columns as they are.

    The counts are made again beside the texts instead of joined to them: that costs less than to deal out all texts.
    """
    model = fit(measure(docs))

    def keep(texts: list[bytes | None]) -> list[bool]:
        c = count_texts([t or b"" for t in texts])
        logit = np.full(len(texts), math.log(model.prior / (1 - model.prior)))
        for k, r in enumerate(RULES):
            bad, good = model.weights(r)
            v = c["pattern"] // 3**k % 3 - 1
            logit += np.where(v > 0, good, np.where(v < 0, bad, 0.0))
        failed = (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])
        return (~failed & (1 / (1 + np.exp(-logit)) >= threshold)).tolist()

    return keep_rows(docs, keep)
