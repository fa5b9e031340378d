"""Work that is long for its bytes is dealt over a number of tasks that is said; few bytes don't bring it into one task."""

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import line_items as L
from ledgerline.plans import inputs
from ledgerline.sources.tables import many_tasks


def test_distinct_lines_are_parsed_by_many_tasks(spark, monkeypatch):
    seen, parse = [], L.parse_lines
    monkeypatch.setattr(L, "parse_lines", lambda df: seen.append(df) or parse(df))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("steel rod qty "), F.col("id").cast("string"), F.lit(" price 5")).alias("text"))
    assert L.parse_distinct(L.split_lines(docs)).where("parsed is not null").count() == 300
    assert seen[0].rdd.getNumPartitions() == many_tasks(spark) > 4


def test_written_orders_are_split_by_many_tasks(spark):
    orders = inputs.written_orders(inputs.po_items(spark, "/root/testdata/sf0.001", spread=True))
    assert orders.rdd.getNumPartitions() == many_tasks(spark)


def test_one_look_finds_what_the_cleaner_changes(spark):
    """Against the cleaner's steps one by one."""
    texts = ["a\n\n\nb", "x 12. bolt", "12. bolt", "x Total: 5", "Grand  Total : 5", "٣. bolt x٣. bolt", "qty5", "Tax5", "gſt5", "35.0 bolt", "1.5. x", "_1. x", "rate", "a\tb", None]
    slow = S.normalize_ocr_text(F.col("t"))
    stripped = slow
    for pattern, to in S._CLEANING:
        slow = F.regexp_replace(slow, f"(?U){pattern}", to)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.clean_ocr_text(F.col("t")).alias("a"), S.strip(slow).alias("b"), stripped.alias("c")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and sum(r.a != r.c for r in rows) >= 4
    amounts = ["35.0 ", " 7", "bolt", "٣", "-5", "l0", "rs. 50 ", "â‚¹ 5", "â€”5", "", None]
    got = spark.createDataFrame([(t,) for t in amounts], "t string").select(S.normalize_currency(F.col("t")).alias("v")).collect()
    assert [r.v for r in got] == [35.0, 7.0, None, None, -5.0, 10.0, 50.0, 5.0, -5.0, None, None]
