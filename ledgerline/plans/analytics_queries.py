"""Registered queries of run history, accuracy and daily counts. Each order with lines is one run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import evaluate as E
from ..operators.reconcile import summarize_pairs
from ..streaming import jobs, pairing
from ..sources.tables import shared_folder, written
from . import inputs
from . import reconcile_queries as Q
from . import text_queries as T
from .registry import query, with_ctes

SEVERITY = "CASE WHEN discrepancies = 0 THEN 'NONE' WHEN discrepancies >= 5 OR abs(rupee_difference) > 5000 THEN 'HIGH' WHEN discrepancies >= 2 OR abs(rupee_difference) > 1000 THEN 'MEDIUM' ELSE 'LOW' END"
RUNS = """runs AS (
  SELECT pair_id::VARCHAR AS run_id, coalesce(regexp_replace(vendor, '\\.[^.]*$', ''), 'Invoice Run') AS vendor, status, discrepancies, ts, total_difference AS rupee_difference,
    round(CASE WHEN discrepancies = 0 THEN 99.8::DOUBLE ELSE greatest(94.0::DOUBLE, 99.8::DOUBLE - discrepancies) END, 1) AS c, coalesce(issues, '') AS issues
  FROM summary LEFT JOIN (SELECT pair_id, string_agg(field, ',' ORDER BY field) AS issues FROM found GROUP BY 1) USING (pair_id))"""
STATS = f"""stats AS (
  SELECT vendor, count(*) AS bills, sum(discrepancies)::BIGINT AS discrepancies, round(sum(discrepancies) * 100.0::DOUBLE / count(*), 4) AS rate, round(avg(c), 4) AS avg_confidence,
    count(*) FILTER (sev = 'LOW') AS low_count, count(*) FILTER (sev = 'MEDIUM') AS medium_count, count(*) FILTER (sev = 'HIGH') AS high_count
  FROM (SELECT *, {SEVERITY} AS sev FROM runs) GROUP BY 1)"""
RUN_CTES = [*Q.SUMMARY_CTES, RUNS]
RISK = "CASE WHEN rate > 20 THEN 'HIGH' WHEN rate > 10 THEN 'MEDIUM' ELSE 'LOW' END AS risk"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.to_runs(summarize_pairs(inputs.pairs(spark, sf_dir), Q.found(spark, sf_dir), issues=True))


@query("a7_filter_history", with_ctes([Q.PAIRS], "SELECT run_id, vendor FROM (SELECT CASE WHEN pair_id % 11 = 0 THEN 'INV-' ELSE '' END || pair_id AS run_id, CASE pair_id % 7 WHEN 0 THEN 'Demo ' || vendor WHEN 1 THEN ' Stripe ' WHEN 2 THEN '' ELSE vendor END AS vendor FROM pairs) WHERE vendor LIKE 'Supplier%' AND run_id NOT LIKE 'INV-%'"))
def filter_history(spark, sf_dir):
    k, id_ = F.col("pair_id") % 7, F.col("pair_id").cast("string")
    vendor = F.when(k == 0, F.concat(F.lit("Demo "), "vendor")).when(k == 1, " Stripe ").when(k == 2, "").otherwise(F.col("vendor"))
    return A.filter_history(inputs.pairs(spark, sf_dir).select(F.when(F.col("pair_id") % 11 == 0, F.concat(F.lit("INV-"), id_)).otherwise(id_).alias("run_id"), vendor.alias("vendor")))


@query("g1_runs", with_ctes(RUN_CTES, "SELECT run_id, vendor, status, discrepancies, ts, rupee_difference, c || '%' AS confidence, issues FROM runs"))
def run_records(spark, sf_dir):
    return runs(spark, sf_dir).drop("duration").withColumn("issues", F.array_join("issues", ","))


@query("g2_kpis", with_ctes(RUN_CTES, "SELECT count(*) AS processed, sum(discrepancies)::BIGINT AS total_discrepancies, round(count(*) FILTER (discrepancies > 0) * 100.0::DOUBLE / count(*), 4) AS flagged_pct, round(avg(c), 4) AS avg_confidence, 0.0::DOUBLE AS avg_duration, round(count(*) FILTER (discrepancies = 0) * 100.0::DOUBLE / count(*), 4) AS success_pct FROM runs"))
def kpis(spark, sf_dir):
    return A.kpis(runs(spark, sf_dir))


@query("g2_formatted_kpis", with_ctes([*RUN_CTES, "kpis AS (SELECT count(*) AS processed, sum(discrepancies)::BIGINT AS total_discrepancies, round(count(*) FILTER (discrepancies > 0) * 100.0::DOUBLE / count(*), 4) AS flagged_pct, round(avg(c), 4) AS avg_confidence, 0.0::DOUBLE AS avg_duration, round(count(*) FILTER (discrepancies = 0) * 100.0::DOUBLE / count(*), 4) AS success_pct FROM runs)"], "SELECT processed, total_discrepancies, printf('%.1f%%', flagged_pct) AS flagged_pct, printf('%.1f%%', avg_confidence) AS avg_confidence, printf('%.1fs', avg_duration) AS avg_duration, printf('%.1f%%', success_pct) AS success_pct FROM kpis"))
def formatted_kpis(spark, sf_dir):
    return A.formatted_kpis(kpis(spark, sf_dir))


@query("g3_vendor_stats", with_ctes([*RUN_CTES, STATS], f"SELECT *, {RISK} FROM stats"))
def vendor_stats(spark, sf_dir):
    return A.vendor_stats(runs(spark, sf_dir))


@query("g4_run_severity", with_ctes(RUN_CTES, f"SELECT run_id, {SEVERITY} AS severity FROM runs"))
def run_severity(spark, sf_dir):
    return runs(spark, sf_dir).select("run_id", A.severity(F.col("discrepancies"), F.col("rupee_difference")).alias("severity"))


@query("g5_vendor_risk", with_ctes([*RUN_CTES, STATS], f"SELECT vendor, rate, {RISK} FROM stats"))
def vendor_risk(spark, sf_dir):
    return A.vendor_stats(runs(spark, sf_dir)).select("vendor", "rate", "risk")


@query("g6_severity_share", with_ctes([*RUN_CTES, STATS], "SELECT vendor, " + ", ".join(f"coalesce(round({k}_count * 100.0::DOUBLE / nullif(low_count + medium_count + high_count, 0), 4), 0) AS {k}_pct" for k in ("low", "medium", "high")) + " FROM stats"))
def severity_share(spark, sf_dir):
    return A.severity_share(A.vendor_stats(runs(spark, sf_dir)))


@query("g7_issue_breakdown", with_ctes(Q.FOUND_CTES, """SELECT label, CASE WHEN label = 'Unit Price Mismatch' THEN n ELSE 0 END AS n, CASE WHEN label = 'Unit Price Mismatch' AND n > 0 THEN 100 ELSE 0 END::BIGINT AS pct
  FROM (VALUES ('Unit Price Mismatch'), ('Missing in Purchase Order'), ('Tax Handling Variance'), ('Quantity Discrepancy')) l(label), (SELECT count(*) AS n FROM found JOIN (SELECT DISTINCT o_orderkey AS pair_id FROM orders) USING (pair_id))"""))
def issue_breakdown(spark, sf_dir):
    return A.issue_breakdown(runs(spark, sf_dir))


@query("g7_issue_breakdown_mapped", with_ctes(Q.FOUND_CTES, """SELECT label, coalesce(n, 0) AS n, coalesce(floor(n * 100.0::DOUBLE / sum(n) OVER () + 0.5), 0)::BIGINT AS pct
  FROM (VALUES ('Unit Price Mismatch'), ('Missing in Purchase Order'), ('Tax Handling Variance'), ('Quantity Discrepancy')) l(label)
  LEFT JOIN (SELECT CASE field WHEN 'quantity' THEN 'Quantity Discrepancy' WHEN 'item' THEN 'Missing in Purchase Order' ELSE 'Unit Price Mismatch' END AS label, count(*) AS n FROM found JOIN (SELECT DISTINCT o_orderkey AS pair_id FROM orders) USING (pair_id) GROUP BY 1) USING (label)"""))
def issue_breakdown_mapped(spark, sf_dir):
    return A.issue_breakdown(runs(spark, sf_dir), {"quantity": "Quantity Discrepancy", "item": "Missing in Purchase Order"})


@query("g8_trend", with_ctes(RUN_CTES, "SELECT run_id, ts, discrepancies, round(discrepancies / greatest(max(discrepancies) OVER (), 4), 6) AS height FROM runs"))
def trend(spark, sf_dir):
    return A.trend(written(runs(spark, sf_dir).select("run_id", "ts", "discrepancies"), "runs"))


@query("g9_telemetry", with_ctes(RUN_CTES, """SELECT ts, seq, event, status FROM (
  SELECT ts, ((rn - 1) * 2)::INT AS seq, 'OCR Ingest layer parsed document: ' || vendor AS event, 'STREAMED' AS status FROM top
  UNION ALL SELECT ts, ((rn - 1) * 2 + 1)::INT, CASE WHEN discrepancies > 0 THEN 'Ledger discrepancy flagged: ' ELSE 'Three-way match succeeded: ' END || vendor, CASE WHEN discrepancies > 0 THEN 'WARNING' ELSE 'COMPLIANCE' END FROM top) WHERE seq < 6""".replace("FROM top", "FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, run_id DESC) AS rn FROM runs QUALIFY rn <= 8)")))
def telemetry(spark, sf_dir):
    return A.telemetry(runs(spark, sf_dir))


@query("g10_search_runs", with_ctes(RUN_CTES, "SELECT run_id, vendor, status, discrepancies FROM runs WHERE run_id LIKE '%7%' OR lower(vendor) LIKE '%7%'"))
def search_runs(spark, sf_dir):
    return A.search_runs(runs(spark, sf_dir), "7", "DISCREPANCY", "DISCREPANCY_DESC").select("run_id", "vendor", "status", "discrepancies")


@query("g11_search_vendors", with_ctes([*RUN_CTES, STATS], f"SELECT vendor, risk FROM (SELECT vendor, {RISK} FROM stats) WHERE vendor LIKE '%1%' AND risk = 'HIGH'"))
def search_vendors(spark, sf_dir):
    return A.search_vendors(A.vendor_stats(runs(spark, sf_dir)), "1", "HIGH").select("vendor", "risk")


@query("g12_ledger_preview", with_ctes(Q.FOUND_CTES, "SELECT pair_id, rn, field || ': ' || item AS line FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY section, item, field_rank) AS rn FROM found) WHERE rn <= 4"))
def ledger_preview(spark, sf_dir):
    return A.ledger_preview(Q.found(spark, sf_dir))


@query("g13_discrepancy_severity", with_ctes(Q.FOUND_CTES, "SELECT pair_id, item, section, field, difference, CASE WHEN difference > 5000 THEN 'HIGH' WHEN difference > 1000 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM found"))
def discrepancy_severity(spark, sf_dir):
    return A.with_severity(Q.found(spark, sf_dir)).select("pair_id", "item", "section", "field", "difference", "severity")


@query("g14_savings", with_ctes(Q.SUMMARY_CTES, f"SELECT pair_id, k AS thousands, '$' || k || 'k' AS label FROM (SELECT pair_id, {Q.half_up('total_difference / 1000', 1)} AS k FROM summary)"))
def savings(spark, sf_dir):
    return A.savings(Q.summary(spark, sf_dir))


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    po = inputs.marked_po_items(spark, sf_dir)
    names = po.groupBy(F.col("pair_id").alias("scenario_id"), "item").agg(F.max_by("qty", "line_no").alias("qty"), F.max_by("price", "line_no").alias("price"))
    parsed = inputs.invoice_items(spark, sf_dir).select(F.col("pair_id").alias("scenario_id"), F.col("line_no").alias("pos"), "item", "qty", "price")
    planned = inputs.po_items(spark, sf_dir).groupBy(F.col("pair_id").alias("scenario_id")).agg(F.count(F.when(F.col("k").isin(0, 1, 3), 1)).alias("expected_discrepancies"))
    actual = Q.found(spark, sf_dir).groupBy(F.col("pair_id").alias("scenario_id")).agg(F.count("*").alias("n"))
    counts = planned.join(actual, "scenario_id", "left").join(T.fallbacks(spark, sf_dir).withColumnRenamed("doc_id", "scenario_id"), "scenario_id", "left")
    counts = counts.select("scenario_id", "expected_discrepancies", F.coalesce("n", F.lit(0)).alias("actual_discrepancies"), "fallback_used")
    return names, parsed, counts


HITS = """expected AS (SELECT pair_id AS scenario_id, item, arg_max(qty, line_no) AS qty, arg_max(price, line_no) AS price FROM po GROUP BY ALL),
names AS (SELECT pair_id AS scenario_id, trim(lower(item)) AS name, min(line_no) AS pos, arg_max_null(qty, line_no) AS qty, arg_max_null(price, line_no) AS price FROM inv GROUP BY ALL),
hits AS (
  SELECT scenario_id, e.item AS expected, e.qty AS expected_qty, e.price AS expected_price, name, pos, n.qty AS qty, n.price AS price
  FROM expected e JOIN names n USING (scenario_id) WHERE contains(name, e.item) OR contains(e.item, name) QUALIFY row_number() OVER (PARTITION BY scenario_id, e.item ORDER BY pos) = 1)"""
ACCURACY = """counts AS (
  SELECT pair_id AS scenario_id, e, coalesce(a, 0) AS a FROM (SELECT pair_id, count(*) FILTER (k IN (0, 1, 3)) AS e FROM po GROUP BY 1) LEFT JOIN (SELECT pair_id, count(*) AS a FROM found GROUP BY 1) USING (pair_id)),
accuracy AS (
  SELECT scenario_id, round(coalesce(q, 0) / greatest(n, 1) * 100, 2) AS quantity_accuracy, round(coalesce(p, 0) / greatest(n, 1) * 100, 2) AS price_accuracy,
    round(CASE WHEN e = 0 THEN greatest(0, 100 - 25.0::DOUBLE * a) ELSE greatest(0, (1 - abs(a - e)::DOUBLE / e) * 100) END, 2) AS discrepancy_accuracy, scenario_id NOT IN (SELECT doc_id FROM valid) AS fallback_used
  FROM counts LEFT JOIN (SELECT scenario_id, count(*) AS n FROM expected GROUP BY 1) USING (scenario_id)
  LEFT JOIN (SELECT scenario_id, count(*) FILTER (qty = expected_qty) AS q, count(*) FILTER (price = expected_price) AS p FROM hits GROUP BY 1) USING (scenario_id))"""


@query("h1_match_expected", with_ctes([Q.PO, Q.RAW, Q.SWAP, Q.INV, HITS], "SELECT * FROM hits"))
def match_expected(spark, sf_dir):
    expected, parsed, _ = _evaluated(spark, sf_dir)
    return E.match_expected(expected, parsed)


@query("h2_scenario_accuracy", with_ctes([*Q.FOUND_CTES, T.VALID, HITS, ACCURACY], "SELECT * FROM accuracy"))
def scenario_accuracy(spark, sf_dir):
    return E.scenario_accuracy(*_evaluated(spark, sf_dir))


@query("h3_accuracy_summary", with_ctes([*Q.FOUND_CTES, T.VALID, HITS, ACCURACY], "SELECT count(*) AS scenarios, round(avg(quantity_accuracy), 2) AS quantity_accuracy, round(avg(price_accuracy), 2) AS price_accuracy, round(avg(discrepancy_accuracy), 2) AS discrepancy_accuracy, round(avg(fallback_used::INT::DOUBLE) * 100, 2) AS fallback_rate FROM accuracy"))
def accuracy_summary(spark, sf_dir):
    return E.accuracy_summary(E.scenario_accuracy(*_evaluated(spark, sf_dir)))


@query("s1_verify_stream", with_ctes(Q.SUMMARY_CTES, "SELECT pair_id, discrepancies, total_difference, status FROM summary"))
def verify_stream(spark, sf_dir):
    """Invoices arrive as files, one row for each pair; each micro-batch is verified and its results written under its number."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    entry = F.struct("line_no", "item", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    items = inputs.invoice_items(spark, sf_dir).groupBy("pair_id").agg(F.collect_list(entry).alias("items"))
    inputs.pairs(spark, sf_dir).select("pair_id").join(items, "pair_id", "left").write.parquet(f"{top}/in")
    jobs.verify_stream(
        jobs.read_arriving(spark, f"{top}/in"), inputs.marked_po_items(spark, sf_dir),
        lambda out, n: out.write.mode("overwrite").parquet(f"{top}/out/batch={n}"), f"{top}/checkpoint",
    ).awaitTermination()
    return spark.read.parquet(f"{top}/out").select("pair_id", "discrepancies", "total_difference", "status")


@query("s1_both_sides", with_ctes(Q.SUMMARY_CTES, """SELECT pair_id, discrepancies, total_difference, status FROM summary WHERE pair_id IN (SELECT pair_id FROM gi) AND pair_id IN (SELECT pair_id FROM gp)"""))
def both_sides(spark, sf_dir):
    """Both sides arrive as documents of their own; a pair is verified when it has both. Those with one side still wait for their deadline."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    entry = F.struct(F.col("line_no").cast("int").alias("line_no"), "item", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    side = lambda items, name: items.groupBy("pair_id").agg(F.collect_list(entry).alias("items")).select("pair_id", F.lit(name).alias("side"), F.lit("2024-01-01").cast("timestamp").alias("ts"), "items")
    documents = side(inputs.invoice_items(spark, sf_dir), "invoice").unionByName(side(inputs.marked_po_items(spark, sf_dir), "po"))
    documents.write.parquet(f"{top}/in")
    stream = jobs.read_arriving(spark, f"{top}/in", pairing.ARRIVING)
    pairing.verify_both_sides(stream, lambda out, n: out.write.mode("overwrite").parquet(f"{top}/out/batch={n}"), f"{top}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{top}/out").select("pair_id", "discrepancies", "total_difference", "status")


@query("s2_daily_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type AS kind, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def daily_counts(spark, sf_dir):
    return jobs.daily_counts(inputs.table(spark, sf_dir, "events"))
