"""Run history: KPIs, vendor risk, issue breakdown, trend, feeds and searches.

Runs have run_id, vendor, status, discrepancies, ts, rupee_difference, duration, confidence and issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import discrepancy_severity, parse_float_prefix, risk, severity

# Vendors of demonstration data, and the labels of the issue breakdown.
MOCK_VENDORS = ["stripe inc.", "atlassian corp", "aws cloud", "gcp enterprise", "slack tech", "microsoft inc.", "stripe inc", "atlassian", "aws-invoice-may.pdf", "stripe"]
ISSUE_LABELS = ["Unit Price Mismatch", "Missing in Purchase Order", "Tax Handling Variance", "Quantity Discrepancy"]
UNKNOWN_VENDOR = "Unknown Vendor"


def filter_history(runs: DataFrame) -> DataFrame:
    """Without runs of no vendor and of demonstration data."""
    v = F.trim(F.lower("vendor"))
    return runs.where(F.col("vendor").isNotNull() & (F.col("vendor") != "") & ~F.col("run_id").startswith("INV-") & ~F.lower("vendor").contains("demo") & ~F.lower("vendor").contains("mock") & ~v.isin(MOCK_VENDORS))


def to_runs(summary: DataFrame, found: DataFrame | None = None, penalty: float = 1.0, least: float = 94.0) -> DataFrame:
    """One run for each pair summary (pair_id, vendor, ts, status, discrepancies, total_difference; issues, else taken from ``found``)."""
    if "issues" not in summary.columns:
        summary = summary.join(found.groupBy("pair_id").agg(F.array_sort(F.collect_list("field")).alias("issues")), "pair_id", "left")
    n = F.col("discrepancies")
    confidence = F.when(n == 0, 99.8).otherwise(F.greatest(F.lit(least), 99.8 - penalty * n))
    return summary.select(
        F.col("pair_id").cast("string").alias("run_id"),
        F.coalesce(F.regexp_replace("vendor", r"\.[^.]*$", ""), F.lit("Invoice Run")).alias("vendor"),
        "status", n.cast("int").alias("discrepancies"), "ts", F.col("total_difference").alias("rupee_difference"), F.lit(None).cast("string").alias("duration"),
        F.concat(F.round(confidence, 1).cast("string"), F.lit("%")).alias("confidence"), F.coalesce("issues", F.array().cast("array<string>")).alias("issues"),
    )


def _confidence() -> Column:
    return parse_float_prefix(F.col("confidence"), 99.8)


def kpis(runs: DataFrame) -> DataFrame:
    """One row of totals; defaults where there is no run."""
    n = F.count("*")
    sums = runs.agg(
        n.alias("processed"),
        F.coalesce(F.sum("discrepancies"), F.lit(0)).alias("total_discrepancies"),
        F.coalesce(F.try_divide(F.count(F.when(F.col("discrepancies") > 0, 1)) * 100.0, n), F.lit(0.0)).alias("flagged_pct"),
        F.coalesce(F.avg(_confidence()), F.lit(99.8)).alias("avg_confidence"),
        F.coalesce(F.avg(parse_float_prefix(F.col("duration"), 0.0)), F.lit(0.0)).alias("avg_duration"),
        F.coalesce(F.try_divide(F.count(F.when(F.col("discrepancies") == 0, 1)) * 100.0, n), F.lit(100.0)).alias("success_pct"),
    )
    return sums.select("processed", "total_discrepancies", *(F.round(c, 4).alias(c) for c in ("flagged_pct", "avg_confidence", "avg_duration", "success_pct")))


def formatted_kpis(one: DataFrame) -> DataFrame:
    return one.select("processed", "total_discrepancies", *(F.format_string(f"%.1f{u}", c).alias(c) for c, u in (("flagged_pct", "%%"), ("avg_confidence", "%%"), ("avg_duration", "s"), ("success_pct", "%%"))))


def vendor_stats(runs: DataFrame) -> DataFrame:
    """Bills, discrepancies, their rate, mean confidence, severity counts and risk of each vendor."""
    s = severity(F.col("discrepancies"), F.col("rupee_difference"))
    rate = F.try_divide(F.sum("discrepancies") * 100.0, F.count("*"))
    vendor = F.coalesce(F.nullif("vendor", F.lit("")), F.lit(UNKNOWN_VENDOR))
    return (
        runs.groupBy(vendor.alias("vendor"))
        .agg(
            F.count("*").alias("bills"),
            F.sum("discrepancies").alias("discrepancies"),
            F.round(rate, 4).alias("rate"),
            F.round(F.avg(_confidence()), 4).alias("avg_confidence"),
            *(F.count(F.when(s == k, 1)).alias(f"{k.lower()}_count") for k in ("LOW", "MEDIUM", "HIGH")),
        )
        .withColumn("risk", risk(F.col("rate")))
    )


def severity_share(stats: DataFrame) -> DataFrame:
    total = F.col("low_count") + F.col("medium_count") + F.col("high_count")
    return stats.select("vendor", *(F.coalesce(F.round(F.try_divide(F.col(f"{k}_count") * 100.0, total), 4), F.lit(0.0)).alias(f"{k}_pct") for k in ("low", "medium", "high")))


def issue_breakdown(runs: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Share of each label in all issues, in whole percent; every label has a row. Issues that name no label count for the first.

    ``mapping`` may translate issue names to labels before.
    """
    issue = F.lower("issue")
    for k, v in (mapping or {}).items():
        issue = F.when(F.lower("issue") == k.lower(), v.lower()).otherwise(issue)
    label = F.lit(ISSUE_LABELS[0])
    for x in ISSUE_LABELS[1:]:
        label = F.when(issue == x.lower(), x).otherwise(label)
    counts = runs.select(F.explode("issues").alias("issue")).groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    labels = runs.sparkSession.createDataFrame([(x,) for x in ISSUE_LABELS], "label string")
    filled = labels.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over four rows
    return filled.withColumn("total", total).select("label", "n", F.coalesce(F.floor(F.try_divide(F.col("n") * 100.0, F.col("total")) + 0.5), F.lit(0)).cast("long").alias("pct"))


def trend(runs: DataFrame) -> DataFrame:
    """Discrepancies of each run against the most of all runs (4 at least), to be read in the order of ts and run_id. ``runs`` should be a written table, as it is read twice."""
    most = runs.agg(F.greatest(F.coalesce(F.max("discrepancies"), F.lit(4)), F.lit(4)).alias("most"))  # one row
    return runs.crossJoin(F.broadcast(most)).select("run_id", "ts", "discrepancies", F.round(F.col("discrepancies") / F.col("most"), 6).alias("height"))


def telemetry(runs: DataFrame, latest: int = 8, events: int = 6) -> DataFrame:
    """The first events of the latest runs: one of intake and one of outcome for each; a single system row if there is no run."""
    top = runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(latest)
    rank = F.row_number().over(Window.orderBy(F.desc("ts"), F.desc("run_id")))  # over at most ``latest`` rows
    flagged = F.col("discrepancies") > 0
    two = F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("OCR Ingest layer parsed document: "), "vendor").alias("event"), F.lit("STREAMED").alias("status")),
        F.struct(F.lit(1).alias("part"), F.concat(F.when(flagged, "Ledger discrepancy flagged: ").otherwise("Three-way match succeeded: "), F.col("vendor")).alias("event"), F.when(flagged, "WARNING").otherwise("COMPLIANCE").alias("status")),
    )
    feed = top.withColumn("rank", rank).select("ts", "rank", F.explode(two).alias("e")).select("ts", ((F.col("rank") - 1) * 2 + F.col("e.part")).cast("int").alias("seq"), "e.event", "e.status").where(F.col("seq") < events)
    none = runs.sparkSession.createDataFrame([(None, 0, "SYSTEM: Telemetry core online.", "SYSTEM")], feed.schema)
    return feed.unionByName(none.join(feed.select(F.lit(1).alias("one")).limit(1), F.lit(True), "left_anti"))


SORTS = {
    "DATE_DESC": [F.desc, "ts"], "DATE_ASC": [F.asc, "ts"], "DISCREPANCY_DESC": [F.desc, "discrepancies"],
    "DISCREPANCY_ASC": [F.asc, "discrepancies"], "VENDOR_ASC": [F.asc, "vendor"], "VENDOR_DESC": [F.desc, "vendor"],
}


def search_runs(runs: DataFrame, term: str = "", status: str = "ALL", sort: str = "DATE_DESC", match_values: tuple[str, ...] = ("MATCH",)) -> DataFrame:
    """Runs whose id or vendor has the term, of the wanted status, in the wanted order."""
    t = term.lower()
    out = runs.where(F.lower("run_id").contains(t) | F.lower("vendor").contains(t))
    if status == "MATCH":
        out = out.where(F.col("status").isin(*match_values))
    elif status == "DISCREPANCY":
        out = out.where(~F.col("status").isin(*match_values))
    order, column = SORTS[sort]
    return out.orderBy(order(column), "run_id")


def search_vendors(stats: DataFrame, term: str = "", risk_level: str = "ALL") -> DataFrame:
    out = stats.where(F.lower("vendor").contains(term.lower()))
    return out if risk_level == "ALL" else out.where(F.col("risk") == risk_level)


def ledger_preview(found: DataFrame, n: int = 4) -> DataFrame:
    """The first discrepancies of each pair as 'field: item'."""
    w = Window.partitionBy("pair_id").orderBy("section", "item", "field_rank")
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).select("pair_id", "rn", F.concat("field", F.lit(": "), "item").alias("line"))


def with_severity(found: DataFrame) -> DataFrame:
    return found.withColumn("severity", discrepancy_severity(F.col("difference")))


def savings(summary: DataFrame) -> DataFrame:
    k = F.round(F.col("total_difference") / 1000, 1)
    return summary.select("pair_id", k.alias("thousands"), F.concat(F.lit("$"), k.cast("string"), F.lit("k")).alias("label"))
