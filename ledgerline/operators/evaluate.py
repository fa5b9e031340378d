"""Accuracy of parsed items and discrepancy counts against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parsed_names(parsed: DataFrame) -> DataFrame:
    """Parsed items by lower-case name: the last row of a name counts, at the place of its first. ``parsed``: scenario_id, pos, item, qty, price."""
    return parsed.groupBy("scenario_id", F.trim(F.lower("item")).alias("name")).agg(F.min("pos").alias("pos"), F.max_by("qty", "pos").alias("qty"), F.max_by("price", "pos").alias("price"))


def match_expected(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """The first parsed name of the scenario that contains an expected name or is contained in it."""
    e = expected.select("scenario_id", F.col("item").alias("expected"), F.col("qty").alias("expected_qty"), F.col("price").alias("expected_price"))
    both = e.join(parsed_names(parsed), "scenario_id").where(F.col("name").contains(F.col("expected")) | F.col("expected").contains(F.col("name")))
    first = Window.partitionBy("scenario_id", "expected").orderBy("pos")
    return both.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def scenario_accuracy(expected: DataFrame, parsed: DataFrame, counts: DataFrame) -> DataFrame:
    """Percentages of each scenario. ``counts``: scenario_id, expected_discrepancies, actual_discrepancies, and fallback_used if it is known:
    whether a side's items come from the parser, or a page was recognized anew. Unknown counts as no."""
    hits = match_expected(expected, parsed).groupBy("scenario_id").agg(
        F.count(F.when(F.col("qty") == F.col("expected_qty"), 1)).alias("q"), F.count(F.when(F.col("price") == F.col("expected_price"), 1)).alias("p")
    )
    sizes = expected.groupBy("scenario_id").agg(F.count("*").alias("n"))
    e, a = F.col("expected_discrepancies"), F.col("actual_discrepancies")
    found = F.when(e == 0, F.greatest(F.lit(0.0), 100.0 - 25.0 * a)).otherwise(F.greatest(F.lit(0.0), (1 - F.coalesce(F.try_divide(F.abs(a - e), e), F.lit(0.0))) * 100))
    n = F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    j = counts.join(sizes, "scenario_id", "left").join(hits, "scenario_id", "left")
    pct = lambda c: F.round(F.coalesce(F.col(c), F.lit(0)) / n * 100, 2)
    fallback = F.coalesce(F.col("fallback_used"), F.lit(False)) if "fallback_used" in counts.columns else F.lit(False)
    return j.select("scenario_id", pct("q").alias("quantity_accuracy"), pct("p").alias("price_accuracy"), F.round(found, 2).alias("discrepancy_accuracy"), fallback.alias("fallback_used"))


def accuracy_summary(accuracy: DataFrame) -> DataFrame:
    """Means over scenarios, and the percentage of scenarios that used a fallback."""
    rate = F.round(F.avg(F.col("fallback_used").cast("double")) * 100, 2).alias("fallback_rate")
    return accuracy.agg(F.count("*").alias("scenarios"), *(F.round(F.avg(c), 2).alias(c) for c in ("quantity_accuracy", "price_accuracy", "discrepancy_accuracy")), rate)
