"""Shared ground of the training-data operators: the shared folder, text passes and the word splitter.

Conventions that hold for every operator of this subpackage unless its docstring says otherwise:

* only ``doc_id`` and ``text`` are read; further columns, whatever their names, do not matter;
* a null text counts as the empty text, and bytes that are not UTF-8 are replaced when decoded;
* rows that repeat are separate documents, and each gets its own result row;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline import ship
from ledgerline.sources.tables import released, shared_folder, stored, written  # noqa: F401  (used by the operators)


#: Rows that go to a Python worker at once. Texts are long: the default of 10,000 would hold tens of megabytes at both ends.
BATCH_ROWS = 2_000


def ready(spark: SparkSession) -> None:
    """Send the package to the executors, and bound the batches of texts for Python workers, unless the session has smaller ones."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: A key is hot from so many rows on, and from one row in so many; so there are never more hot keys than the second number.
HOT_ROWS, HOT_SHARE, HOT_PARTS = 1_000, 1_000, 32


def hot_keys(rows: DataFrame, key: str) -> list:
    """The values of ``key`` that hold more than 1 / HOT_SHARE of the rows, hence HOT_SHARE of them at most."""
    least = max(HOT_ROWS, rows.count() / HOT_SHARE)
    return [r[0] for r in rows.groupBy(key).count().where(F.col("count") > least).select(key).collect()]


def join_hot(left: DataFrame, right: DataFrame, key: str, by: str, hot: list | None = None) -> DataFrame:
    """Inner join of ``left``, where a key may be hot, with ``right``, where keys (nearly) never repeat.

    The rows of hot keys are spread over HOT_PARTS places by a hash of ``by``; their few rows on the right are repeated.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key)
    is_hot = F.col(key).isin(hot)
    left = left.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(by), F.lit(HOT_PARTS))).otherwise(0).cast("int"))
    every = F.array(*(F.lit(k) for k in range(HOT_PARTS)))
    right = right.withColumn("_part", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_part"]).drop("_part")


def text_batches(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as bytes; null gives the empty text."""
    return [t if t is not None else b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def map_texts(docs: DataFrame, schema: str, work: Callable[[list[bytes]], dict]) -> DataFrame:
    """One result row for each document: ``doc_id`` and the columns that ``work`` makes of a batch of texts."""
    full = docs.sparkSession.createDataFrame([], f"doc_id long, {schema}").schema
    names = [f.name for f in full][1:]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(text_batches(batch))
            columns = [batch.column("doc_id"), *(made[n] for n in names)]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow
            )

    return id_and_text(docs).mapInArrow(run, full)


def keep_rows(docs: DataFrame, keep: Callable[[list[bytes | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` that ``keep`` accepts, all columns as they are; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(keep(texts), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
