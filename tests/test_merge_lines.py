import time

from pyspark.sql import functions as F

from ledgerline.operators import line_items as L


def test_long_runs_of_lines_are_looked_at_once(spark):
    """What the fold asks of joined lines comes from their marks: no pattern is matched against the lines joined so far."""
    text = "\n".join(["plain words without amounts"] * 3_000)
    df = spark.createDataFrame([(text,)], "text string").select(F.size(L.merge_lines(F.split("text", "\n"))).alias("n"))
    df.collect()
    began = time.time()
    assert df.collect()[0].n == 1
    assert time.time() - began < 4
    halves = spark.createDataFrame([(["our purchase", "order then", "qty 5"],), (["repurchase", "order then", "qty 5"],)], "x array<string>")
    assert [r.m for r in halves.select(L.merge_lines(F.col("x")).alias("m")).collect()] == [["our purchase order then", "qty 5"], ["repurchase order then qty 5"]]
