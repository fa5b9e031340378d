"""Item names: field labels, also misread ones, are found in Arrow batches; everything else is built-in expressions.

A batch's distinct words are told labels or not at once, and a worker remembers the words it has seen."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .matching import labels_among
from .scalars import normalize_ocr_text, squeeze, trim_name

_LETTER = re.compile(r"[^\W\d_]")
_KNOWN: dict[str, bool] = {}
_REMEMBER = 200_000


def _told(words: set[str]) -> dict[str, bool]:
    if len(_KNOWN) > _REMEMBER:
        _KNOWN.clear()
    # digits and marks alone are never close enough to a label, so only words with a letter are looked at and remembered
    new = {w for w in words - _KNOWN.keys() if _LETTER.search(w)}
    labels = labels_among(new)
    _KNOWN.update((w, w in labels) for w in new)
    return _KNOWN


def _labels_of(words: pd.Series, texts: pd.Series) -> pd.DataFrame:
    split = [None if some is None else [None if t is None else t.split() for t in some] for some in texts]
    told = _told({w for some in words if some is not None for w in some} | {w for some in split if some for t in some if t for w in t})
    without = [None if some is None else [None if t is None else " ".join(w for w in t if not told.get(w, False)) for t in some] for some in split]
    return pd.DataFrame({"flags": [None if some is None else [told.get(w, False) for w in some] for some in words], "texts": without})


def _no_labels(names: pd.Series) -> pd.Series:
    some = names.dropna().unique()
    told = _told({w for n in some for w in n.split()})
    free = {n: not any(told.get(w, False) for w in n.split()) for n in some}
    return names.map(lambda n: free.get(n, False)).astype(bool)


def has_no_labels(name: Column) -> Column:
    """Whether no word of a name is a field label; false for null."""
    return F.pandas_udf(_no_labels, "boolean")(name)


def without_labels(words: Column, texts: Column) -> Column:
    """struct<flags, texts>: whether each of ``words`` is a field label, and ``texts``, repaired and in lower case, without their labels."""
    repaired = F.transform(texts, lambda t: F.when(t.isNotNull(), squeeze(F.lower(normalize_ocr_text(t)))))
    return F.pandas_udf(_labels_of, "flags array<boolean>, texts array<string>")(words, repaired)


def normalize_item_name(col: Column) -> Column:
    """The name of an item: repaired, in lower case, without labels, numbers and edge punctuation; null for null."""
    return trim_name(F.get(without_labels(F.array().cast("array<string>"), F.array(col))["texts"], F.lit(0)))
