"""Token-set similarity of short names. The only scoring that built-in expressions can't do: the names of a pair's two sides are
compared in Arrow batches, and a worker remembers the scores of pairs of names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field labels, and characters that stand for others in them.
FIELD_LABELS = ["item", "qty", "quantity", "price", "rate", "amount", "tax", "gst", "vat", "total"]
LABEL_LOOKALIKES = {"0": "o", "1": "i", "5": "s", "|": "i", "!": "i", "l": "i", "v": "y"}
LABEL_RATIO = 0.72

_EDGES, _LETTERS = re.compile(r"^[\W_]+|[\W_]+$"), str.maketrans(LABEL_LOOKALIKES)


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine word operation for each character of b."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    free = mask = (1 << len(a)) - 1
    for c in b:
        hit = free & where.get(c, 0)
        free = ((free + hit) | (free - hit)) & mask
    return len(a) - free.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """0 to 100: likeness of two names by the tokens they share and what is left of each."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = x & y, " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 100.0
    shared = len(" ".join(sorted(both)))
    gap = 1 if shared else 0
    nx, ny = shared + gap + len(only_x), shared + gap + len(only_y)
    apart = len(only_x) + len(only_y) - 2 * common_subsequence(only_x, only_y)
    best = 100 - 100 * apart / (nx + ny)
    if shared:
        best = max(best, 100 - 100 * (gap + len(only_x)) / (shared + nx), 100 - 100 * (gap + len(only_y)) / (shared + ny))
    return best


class Names:
    """The names of one side of a pair, for finding those that are like a given one without scoring each.

    Without a shared token the score is at most what the letters that two names have in common allow; that bound is
    worked out for all names at once. Names with a shared token are scored.
    """

    def __init__(self, names: list[str]):
        # as in the score, a name is its distinct tokens
        self.names, self.plain = names, [" ".join(sorted(set(n.split()))) for n in names]
        alphabet = sorted({c for n in self.plain for c in n})
        self.letters = {c: k for k, c in enumerate(alphabet)}
        self.counts = np.zeros((len(names), len(alphabet)), dtype=np.int16)
        for k, n in enumerate(self.plain):
            for c in n:
                self.counts[k, self.letters[c]] += 1
        self.length = np.array([len(n) for n in self.plain], dtype=np.int64)
        self.with_token: dict[str, list[int]] = {}
        for k, n in enumerate(names):
            for t in set(n.split()):
                self.with_token.setdefault(t, []).append(k)

    def like(self, name: str, threshold: float) -> list[tuple[int, float]]:
        """(number, score) of the names with at least the threshold."""
        plain = " ".join(sorted(set(name.split())))
        own = np.zeros(len(self.letters), dtype=np.int16)
        for c in plain:
            if c in self.letters:
                own[self.letters[c]] += 1
        common = np.minimum(self.counts, own).sum(1)
        both = self.length + len(plain)
        # a hair below the threshold, so that rounding loses nothing
        near = set(np.flatnonzero((200 * common >= (threshold - 1e-6) * both) & (both > 0)).tolist())
        near.update(k for t in set(name.split()) for k in self.with_token.get(t, ()))
        return [(k, s) for k in sorted(near) if (s := _scored(name, self.names[k])) >= threshold]


@lru_cache(maxsize=100_000)
def _scored(a: str, b: str) -> float:
    return token_set_ratio(a, b)


def _exact(a: list[str], b: list[str]) -> list[list[tuple[int, float]]]:
    at: dict[str, list[int]] = {}
    for k, n in enumerate(b):
        if n:
            at.setdefault(n, []).append(k)
    return [[(k, 100.0) for k in at.get(n, ())] for n in a]


def like_names(threshold: float, scorer: str = "token_set", greedy: bool = False) -> Callable[[Column, Column], Column]:
    """A function of two arrays of matching keys: array of struct<a, b, score>, the numbers from 0 of the names of both that score enough.

    With ``greedy`` each name of the first, in order, takes the best free one of the second (of equal ones the first).
    """

    def find(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(left, right):
            a, b = list(a), list(b)
            if scorer == "exact":
                found = _exact(a, b)
            else:
                index = Names(b)
                found = [index.like(n, threshold) if n else [] for n in a]
            if greedy:
                taken: set[int] = set()
                for i, hits in enumerate(found):
                    best = min(((-s, k) for k, s in hits if k not in taken), default=None)
                    found[i] = [(best[1], -best[0])] if best else []
                    taken.update(k for k, _ in found[i])
            out.append([{"a": i, "b": k, "score": s} for i, hits in enumerate(found) for k, s in hits])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(find, "array<struct<a:int,b:int,score:double>>")


def labels_among(words: set[str], labels: list[str] | None = None) -> set[str]:
    """Those of ``words`` that are a field label, or nearly so once misread characters are mapped.

    The words are reduced to their letters first, so that each distinct core meets each label of about its length once.
    """
    cores: dict[str, list[str]] = {}
    for w in words:
        edges = _EDGES.sub("", w.lower()).translate(_LETTERS)
        cores.setdefault("".join(c for c in edges if "a" <= c <= "z"), []).append(w)
    cores.pop("", None)
    found: set[str] = cores.keys() & set(labels or FIELD_LABELS)
    for label in labels or FIELD_LABELS:
        near = SequenceMatcher(None, b=label)
        for core in cores.keys() - found:
            if abs(len(core) - len(label)) <= 2:
                near.set_seq1(core)
                if near.quick_ratio() >= LABEL_RATIO and near.ratio() >= LABEL_RATIO:
                    found.add(core)
    return {w for core in found for w in cores[core]}


def label_tokens(tokens: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """token and is_label of the distinct values of the column ``token``; each is scored once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(is_label=b["token"].isin(labels_among(set(b["token"].dropna()), labels)))

    return tokens.select("token").distinct().mapInPandas(run, "token string, is_label boolean")
