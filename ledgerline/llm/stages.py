"""The stages of the corpus pipeline: operators applied to what the stage before has kept, all columns as they are."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import language_id as language
from . import near_dedup as near
from . import packing
from . import quality_rules as rules
from . import substring_dedup as substring
from . import worker_tables
from .common import keep_rows, ready
from .encoding import library_ids

#: A text whose likeliest language has less than this mean probability is rejected.
LEAST_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without letters, and doubtful ones. Without labelled rows nothing but the first two go."""
    ready(spark)
    net = language.fit(docs)
    bound = spark.sparkContext.broadcast(net)

    def keep(texts: list[bytes | None]) -> list[bool]:
        worker_tables.only(None)
        out: list[bool] = []
        texts = [t or b"" for t in texts]
        for some in map(texts.__getitem__, language.in_groups(texts)):
            letters = [language.has_letters(t) for t in some]
            if bound.value is None:
                out += letters
            else:
                _, scores = language.label_texts(bound.value, some, letters)
                out += [ok and s >= LEAST_SCORE for ok, s in zip(letters, scores)]
        return out

    return keep_rows(docs, keep)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return rules.kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return near.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return substring.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    ready(spark)
    return packing.pack_documents(docs, partial(library_ids, P.path("byte_bpe_50k.json"), P.PATTERN), end_id=0, capacity=2048)
