"""Registered queries of the reconciliation operators on invoices and purchase orders made from the order lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..operators.fuzzy_join import assign_in_rounds, large_candidates
from ..operators.verify import verify_texts
from ..functions.scalars import difference, entry_text, is_trailing_drift
from ..sources import files
from ..sources.tables import shared_folder, written
from . import inputs
from .registry import query, with_ctes

# --- SQL of the inputs and of each step, to be chained ----------------------------------------------------------------

PO = """po AS (
  SELECT l_orderkey AS pair_id,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax) AS INT) AS line_no,
    lower(p_name) AS item, l_quantity AS qty, p_retailprice AS price, round(l_tax * 100, 2) AS tax, l_extendedprice AS total,
    (l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 20 AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
RAW = """raw AS (
  SELECT pair_id, line_no, CASE WHEN k = 5 THEN replace(item, 'o', '0') ELSE item END AS item,
    CASE k WHEN 1 THEN qty + 12 WHEN 2 THEN qty + 1 WHEN 6 THEN NULL WHEN 8 THEN price ELSE qty END AS qty,
    CASE k WHEN 3 THEN price + 1000 WHEN 4 THEN price + 9 WHEN 8 THEN qty ELSE price END AS price,
    tax, CASE WHEN k IN (7, 8) THEN NULL ELSE total END AS total
  FROM po WHERE k <> 0)"""
SWAP = """swap AS (
  SELECT pair_id, line_no, item, tax, total, s AS swapped, CASE WHEN s THEN price ELSE qty END AS q, CASE WHEN s THEN qty ELSE price END AS p, 1 + coalesce(tax, 0) / 100.0 AS f
  FROM (SELECT *, coalesce(total IS NULL AND qty > 200 AND price <= 200 AND qty > price, false) AS s FROM raw))"""


def half_up(x: str, places: int = 2) -> str:
    """Rounding of a double by its shortest decimal form, ties away from zero, as Spark rounds."""
    return f"round(({x})::VARCHAR::DECIMAL(38, 16), {places})::DOUBLE"


INV = f"""inv AS (
  SELECT pair_id, line_no, item, coalesce(q, nq) AS qty, coalesce(p, np) AS price, tax, coalesce(total, nt) AS total, swapped, coalesce(nt, nq, np) IS NOT NULL AS reconstructed
  FROM (SELECT *,
      CASE WHEN total IS NULL THEN {half_up('q * p * f')} END AS nt,
      CASE WHEN q IS NULL AND p > 0 THEN
        CASE WHEN abs(total / p - round_even(total / p, 0)) < 0.01 AND total / p > 0 AND total / p <= 1000 THEN round_even(total / p, 0)
             WHEN abs(total / f / p - round_even(total / f / p, 0)) < 0.01 AND total / f / p > 0 AND total / f / p <= 1000 THEN round_even(total / f / p, 0) END END AS nq,
      CASE WHEN p IS NULL AND q > 0 THEN {half_up('total / q / f')} END AS np
    FROM swap))"""


def _groups(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT pair_id, item, count(*) AS entry_count, coalesce(sum(qty), 0) AS qty, count(qty) > 0 AS has_qty, CASE WHEN min(price) = max(price) THEN min(price) END AS price
  FROM {source} WHERE trim(item) <> '' GROUP BY ALL)"""


ALIGNED = """aligned AS (
  SELECT coalesce(i.pair_id, p.pair_id) AS pair_id, coalesce(i.item, p.item) AS item, i.qty AS inv_qty, i.has_qty AS inv_has_qty, i.price AS inv_price, i.entry_count AS inv_entry_count,
    p.qty AS po_qty, p.has_qty AS po_has_qty, p.price AS po_price, p.entry_count AS po_entry_count,
    CASE WHEN i.item IS NULL THEN 'po_only' WHEN p.item IS NULL THEN 'invoice_only' ELSE 'exact' END AS section
  FROM gi i FULL JOIN gp p ON i.pair_id = p.pair_id AND i.item = p.item)"""
MATCH_KEY = r"trim(regexp_replace(regexp_replace(regexp_replace(translate(lower({0}), '01358', 'oleso'), '[^a-z0-9\s]', ' ', 'g'), '\b(j|l|i|o|0|s|oty|oiy|otr|ltem|ltems)\b', ' ', 'g'), '\s+', ' ', 'g'))"
NEAR = f"""near AS (
  SELECT a.pair_id, a.item AS inv_item, b.item AS po_item, {MATCH_KEY.format('a.item')} AS x, {MATCH_KEY.format('b.item')} AS y
  FROM aligned a JOIN aligned b ON a.pair_id = b.pair_id AND a.section = 'invoice_only' AND b.section = 'po_only')"""
#: Token-set likeness: the longest common subsequence of what the names don't share is built letter by letter.
SCORES = """parts AS (
  SELECT x, y, common, ox, oy FROM (
    SELECT x, y, array_to_string(list_sort(list_intersect(tx, ty)), ' ') AS common,
      array_to_string(list_sort(list_filter(list_distinct(tx), lambda t: NOT list_contains(ty, t))), ' ') AS ox,
      array_to_string(list_sort(list_filter(list_distinct(ty), lambda t: NOT list_contains(tx, t))), ' ') AS oy
    FROM (SELECT DISTINCT x, y, string_split(x, ' ') AS tx, string_split(y, ' ') AS ty FROM near WHERE x <> '' AND y <> ''))),
lcs AS (
  SELECT DISTINCT ox, oy, 0 AS j, list_transform(range(0, length(ox) + 1), lambda i: 0) AS r FROM parts
  UNION ALL
  SELECT ox, oy, j + 1, list_transform(range(0, length(ox) + 1), lambda i: greatest(r[i + 1],
    coalesce(list_max(list_transform(list_filter(range(1, i + 1), lambda k: substr(ox, k, 1) = substr(oy, j + 1, 1)), lambda k: r[k] + 1)), 0)))
  FROM lcs WHERE j < length(oy)),
lengths AS (
  SELECT x, y, length(common) AS n, (length(common) > 0)::INT AS g, length(p.ox) AS nx, length(p.oy) AS ny, length(p.ox) + length(p.oy) - 2 * r[-1] AS apart
  FROM parts p JOIN lcs l ON p.ox = l.ox AND p.oy = l.oy AND l.j = length(l.oy)),
scores AS (
  SELECT x, y, CASE WHEN n > 0 AND (nx = 0 OR ny = 0) THEN 100.0::DOUBLE ELSE greatest(100 - 100 * apart::DOUBLE / (2 * (n + g) + nx + ny),
    CASE WHEN n > 0 THEN 100 - 100 * (g + nx)::DOUBLE / (2 * n + g + nx) ELSE 0 END, CASE WHEN n > 0 THEN 100 - 100 * (g + ny)::DOUBLE / (2 * n + g + ny) ELSE 0 END) END AS score
  FROM lengths)"""
CANDS = "cands AS (SELECT pair_id, inv_item, po_item, score FROM near JOIN scores USING (x, y) WHERE score >= 85)"
GREEDY = """turns AS (
  SELECT pair_id, inv_item, row_number() OVER (PARTITION BY pair_id ORDER BY inv_item) AS turn, list({'po': po_item, 's': score} ORDER BY score DESC, po_item) AS choice
  FROM cands GROUP BY pair_id, inv_item),
fold AS (
  SELECT DISTINCT pair_id, 0::BIGINT AS turn, []::VARCHAR[] AS taken, NULL::VARCHAR AS inv_item, NULL::VARCHAR AS po_item, NULL::DOUBLE AS score FROM turns
  UNION ALL
  SELECT pair_id, turn, CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.po) END, inv_item, best.po, best.s
  FROM (SELECT f.pair_id, t.turn, f.taken, t.inv_item, list_filter(t.choice, lambda c: NOT list_contains(f.taken, c.po))[1] AS best
    FROM fold f JOIN turns t ON t.pair_id = f.pair_id AND t.turn = f.turn + 1)),
matches AS (SELECT pair_id, inv_item, po_item, score FROM fold WHERE po_item IS NOT NULL)"""
MATCHED = """matched AS (
  SELECT pair_id, item, '3_exact' AS section, inv_qty, inv_has_qty, inv_price, po_qty, po_has_qty, po_price FROM aligned WHERE section = 'exact'
  UNION ALL
  SELECT m.pair_id, m.inv_item, '4_fuzzy', i.inv_qty, i.inv_has_qty, i.inv_price, p.po_qty, p.po_has_qty, p.po_price
  FROM matches m JOIN aligned i ON i.pair_id = m.pair_id AND i.item = m.inv_item AND i.section = 'invoice_only' JOIN aligned p ON p.pair_id = m.pair_id AND p.item = m.po_item AND p.section = 'po_only')"""


def drift_sql(a: str, b: str) -> str:
    near = " OR ".join(
        f"(round_even({a} / {n}, 0) * {n} = round_even({b} / {n}, 0) * {n} AND (fmod({a}, {n}) IN (0, 8, 9, 98, 99) OR fmod({b}, {n}) IN (0, 8, 9, 98, 99)))" for n in (10, 100)
    )
    return f"(abs({a} - {b}) IN (1, 2, 8, 9, 18, 19, 98, 99) OR {near})"


COMPARED = f"""compared_q AS (
  SELECT *, CASE WHEN NOT (inv_has_qty AND po_has_qty) OR inv_qty = po_qty THEN 'none'
    WHEN {drift_sql('inv_qty', 'po_qty')} THEN CASE WHEN abs(inv_qty - po_qty) <= 1 THEN 'suppressed' ELSE 'review' END ELSE 'mismatch' END AS qty_check FROM matched),
compared AS (
  SELECT *, CASE WHEN qty_check = 'suppressed' OR inv_price IS NULL OR po_price IS NULL OR inv_price = po_price THEN 'none'
    WHEN {drift_sql('inv_price', 'po_price')} THEN CASE WHEN abs(inv_price - po_price) <= 1 OR abs(inv_price - po_price) / greatest(inv_price, po_price) < 0.01 THEN 'suppressed' ELSE 'review' END
    ELSE 'mismatch' END AS price_check FROM compared_q)"""
MISSING = """missing AS (
  SELECT pair_id, item, '5_po_only' AS section, 'missing_in_invoice' AS type, 'missing in invoice' AS issue, po_entry_count AS entry_count FROM aligned a
  WHERE section = 'po_only' AND NOT EXISTS (FROM matches m WHERE m.pair_id = a.pair_id AND m.po_item = a.item)
  UNION ALL
  SELECT pair_id, item, '6_invoice_only', 'missing_in_po', 'missing in PO', inv_entry_count FROM aligned a
  WHERE section = 'invoice_only' AND NOT EXISTS (FROM matches m WHERE m.pair_id = a.pair_id AND m.inv_item = a.item))"""
DUPLICATES = """duplicates AS (
  SELECT pair_id, item, '1_dup_invoice' AS section, 'duplicate_item' AS type, 'duplicate item in invoice' AS issue, entry_count FROM gi WHERE entry_count > 1
  UNION ALL SELECT pair_id, item, '2_dup_po', 'duplicate_item', 'duplicate item in po', entry_count FROM gp WHERE entry_count > 1)"""


def _values(field: str, rank: int, name: str) -> str:
    return f"""SELECT pair_id, item, section, '{field}_mismatch' AS type, '{field}' AS field, {rank} AS field_rank, inv_{name} AS invoice_num, po_{name} AS po_num,
    round(abs(inv_{name} - po_{name}), 2) AS difference, '{field} mismatch' || CASE WHEN {name}_check = 'review' THEN ' (probable OCR noise)' ELSE '' END AS issue, {name}_check = 'review' AS review_required, NULL::BIGINT AS entry_count
  FROM compared WHERE {name}_check IN ('review', 'mismatch')"""


FOUND = f"""found AS (
  {_values('quantity', 0, 'qty')}
  UNION ALL {_values('price', 1, 'price')}
  UNION ALL SELECT pair_id, item, section, type, 'item', 0, NULL, NULL, NULL, issue, false, entry_count FROM (FROM missing UNION ALL FROM duplicates))"""
PAIRS = """pairs AS (
  SELECT o_orderkey AS pair_id, o_orderdate AS ts, s_name AS vendor
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey LEFT JOIN supplier ON s = s_suppkey)"""
SUMMARY = """summary AS (
  SELECT pair_id, ts, vendor, coalesce(n, 0) AS discrepancies, CASE WHEN n > 0 THEN n || ' discrepancy(s) found.' ELSE 'No discrepancies found.' END AS summary,
    coalesce(d, 0) AS total_difference, CASE WHEN n > 0 THEN 'Discrepancies Found' ELSE 'No Discrepancies Found' END AS status
  FROM pairs LEFT JOIN (SELECT pair_id, count(*) AS n, round(sum(difference), 2) AS d FROM found GROUP BY 1) USING (pair_id))"""
FLAGS = """flags AS (
  SELECT pair_id, concat_ws(',', CASE WHEN swapped THEN 'POSSIBLE_COLUMN_SHIFT' END, CASE WHEN reconstructed THEN 'MATHEMATICAL_RECONSTRUCTION_USED' END,
    CASE WHEN coalesce(u, 0) / (greatest(coalesce(ni, 0), 1) + greatest(coalesce(np, 0), 1)) > 0.35 OR coalesce(nf, 0) > 2 THEN 'LOW_MATCH_CONFIDENCE' END) AS flags
  FROM pairs
  LEFT JOIN (SELECT pair_id, bool_or(swapped) AS swapped, bool_or(reconstructed) AS reconstructed FROM inv GROUP BY 1) USING (pair_id)
  LEFT JOIN (SELECT pair_id, count(inv_entry_count) AS ni, count(po_entry_count) AS np, count(*) FILTER (section <> 'exact') AS u FROM aligned GROUP BY 1) USING (pair_id)
  LEFT JOIN (SELECT pair_id, count(*) AS nf FROM found GROUP BY 1) USING (pair_id))"""
OUTCOME = """outcome AS (
  SELECT pair_id, CASE WHEN a.pair_id IS NULL AND b.pair_id IS NULL THEN 'Could not parse structured invoice line items from OCR text.' END AS error,
    CASE WHEN a.pair_id IS NULL AND b.pair_id IS NOT NULL THEN 'Invoice parser returned no line items; continuing reconciliation with PO items only. invoice_failure_reason=None'
         WHEN b.pair_id IS NULL AND a.pair_id IS NOT NULL THEN 'PO parser returned no line items; continuing reconciliation with invoice items only. po_failure_reason=None' END AS warning
  FROM pairs LEFT JOIN (SELECT DISTINCT pair_id FROM gi) a USING (pair_id) LEFT JOIN (SELECT DISTINCT pair_id FROM gp) b USING (pair_id))"""

_INPUT = [PO, RAW, SWAP, INV]
_GROUPED = [*_INPUT, _groups("gi", "inv"), _groups("gp", "po"), ALIGNED]
_FUZZY = [*_GROUPED, NEAR, SCORES, CANDS]
_ASSIGNED = [*_FUZZY, GREEDY]
FOUND_CTES = [*_ASSIGNED, MATCHED, COMPARED, MISSING, DUPLICATES, FOUND]
SUMMARY_CTES = [*FOUND_CTES, PAIRS, SUMMARY]

# --- steps in Spark ---------------------------------------------------------------------------------------------------


def grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return R.group_items(inputs.invoice_items(spark, sf_dir)), R.group_items(inputs.marked_po_items(spark, sf_dir))


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.align_sides(inputs.both_sides(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.discrepancies_of(aligned(spark, sf_dir))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summarize_pairs(inputs.pairs(spark, sf_dir), found(spark, sf_dir))


def flags(spark: SparkSession, sf_dir: str, once: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    inv, po = inputs.invoice_items(spark, sf_dir), inputs.marked_po_items(spark, sf_dir)
    return R.confidence_flags(inputs.pairs(spark, sf_dir), inv, po, *(once or _once(spark, sf_dir)))


def _once(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The aligned groups and their discrepancies, written once for queries that read them several times."""
    a = written(aligned(spark, sf_dir), "aligned")
    return a, written(R.discrepancies_at_any_size(a), "found")


def outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pair_outcome(inputs.pairs(spark, sf_dir), *grouped(spark, sf_dir))


@query("d11_reconcile_math", with_ctes(_INPUT, "SELECT * FROM inv"))
def reconcile_math(spark, sf_dir):
    return inputs.invoice_items(spark, sf_dir)


@query("f1_group_items", with_ctes([*_INPUT, _groups("gi", "inv")], "SELECT *, entry_count > 1 AS has_duplicate FROM gi"))
def group_items(spark, sf_dir):
    return grouped(spark, sf_dir)[0]


@query("f1_duplicate_entries", with_ctes([*_INPUT, _groups("gi", "inv")], """SELECT pair_id, item, array_to_string(list(inv.line_no || ':' || coalesce(CAST(round(inv.qty, 0) AS INT)::VARCHAR, '-') ORDER BY line_no), ' ') AS entries
  FROM inv JOIN (SELECT pair_id, item FROM gi WHERE entry_count > 1) USING (pair_id, item) GROUP BY ALL"""))
def duplicate_entries(spark, sf_dir):
    items = inputs.invoice_items(spark, sf_dir)
    shown = F.transform("entries", lambda e: F.concat(e["line_no"].cast("string"), F.lit(":"), F.coalesce(F.round(e["qty"], 0).cast("int").cast("string"), F.lit("-"))))
    return R.entries(items, R.group_items(items).where("has_duplicate")).select("pair_id", "item", F.array_join(shown, " ").alias("entries"))


@query("f2_match_exact", with_ctes(_GROUPED, "SELECT pair_id, item FROM aligned WHERE section = 'exact'"))
def match_exact(spark, sf_dir):
    return R.match_exact(*grouped(spark, sf_dir))


@query("f3_unmatched", with_ctes(_GROUPED, "SELECT pair_id, item, CASE section WHEN 'po_only' THEN 'po' ELSE 'invoice' END AS side FROM aligned WHERE section <> 'exact'"))
def unmatched(spark, sf_dir):
    inv, po = (g.select("pair_id", "item") for g in grouped(spark, sf_dir))
    return R.unmatched(inv, po).withColumn("side", F.lit("invoice")).unionByName(R.unmatched(po, inv).withColumn("side", F.lit("po")))


@query("f4_fuzzy_candidates", with_ctes(_FUZZY, "SELECT pair_id, inv_item, po_item, round(score, 6) AS score FROM cands"))
def fuzzy_candidates(spark, sf_dir):
    a = aligned(spark, sf_dir)
    return R.fuzzy_candidates(a.where("section = 'invoice_only'"), a.where("section = 'po_only'")).withColumn("score", F.round("score", 6))


@query("f5_greedy_assignment", with_ctes(_ASSIGNED, "SELECT pair_id, inv_item, po_item, round(score, 6) AS score FROM matches"))
def greedy_assignment(spark, sf_dir):
    return R.fuzzy_matches(aligned(spark, sf_dir)).withColumn("score", F.round("score", 6))


def _compared(spark, sf_dir):
    a = aligned(spark, sf_dir)
    return R.compare_values(R.matched_pairs(a, R.fuzzy_matches(a)))


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All part names as the two sides of one pair: as they are, and, of two in three, as a scanner might misread them."""
    names = inputs.table(spark, sf_dir, "part").select(F.lit(1).cast("long").alias("pair_id"), "p_partkey", F.lower("p_name").alias("item"))
    k = F.col("p_partkey") % 6
    read = F.when(k == 0, F.replace("item", F.lit("e"), F.lit("c"))).when(k == 1, F.concat("item", F.lit(" x"))).when(k == 2, F.regexp_replace("item", "(.)$", "")).when(k == 3, F.regexp_replace("item", "^(..)", "$1$1")).otherwise(F.col("item"))
    side = lambda c: names.select("pair_id", c.alias("item")).distinct()
    return side(read), side(F.col("item"))


@query("f4_catalogue_candidates")
def catalogue_candidates(spark, sf_dir):
    """One pair with all names of the parts; the search is spread over tasks."""
    return large_candidates(*_catalogue(spark, sf_dir), R.ITEM_MATCH_THRESHOLD)


@query("f5_catalogue_assignment")
def catalogue_assignment(spark, sf_dir):
    """The one-to-one matches of the catalogue, in rounds of mutual best."""
    return assign_in_rounds(catalogue_candidates(spark, sf_dir))


@query("f6_quantity_check", with_ctes([*_ASSIGNED, MATCHED, COMPARED], "SELECT pair_id, item, section, inv_qty, po_qty, qty_check FROM compared"))
def quantity_check(spark, sf_dir):
    return _compared(spark, sf_dir).select("pair_id", "item", "section", "inv_qty", "po_qty", "qty_check")


@query("f7_price_check", with_ctes([*_ASSIGNED, MATCHED, COMPARED], "SELECT pair_id, item, section, inv_price, po_price, price_check FROM compared"))
def price_check(spark, sf_dir):
    return _compared(spark, sf_dir).select("pair_id", "item", "section", "inv_price", "po_price", "price_check")


#: The lines behind each name of a side, as a reader sees them.
ENTRIES = """entries AS (
  SELECT side, pair_id, item, string_agg(coalesce(qty::VARCHAR, '-') || ' x ' || coalesce(price::VARCHAR, '-'), '; ' ORDER BY line_no) AS entries
  FROM (SELECT 'invoice' AS side, pair_id, line_no, item, qty, price FROM inv UNION ALL SELECT 'po', pair_id, line_no, item, qty, price FROM po) GROUP BY ALL)"""


def _with_entries(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    both = R.with_entries(rows, inputs.invoice_items(spark, sf_dir), inputs.marked_po_items(spark, sf_dir))
    return both.withColumn("entries", entry_text(F.col("entries"))).select("pair_id", "item", "section", "type", "issue", "entry_count", "entries")


@query("f8_missing_items", with_ctes([*_ASSIGNED, MISSING, ENTRIES], "SELECT m.pair_id, m.item, section, type, issue, entry_count, entries FROM missing m JOIN entries e ON e.pair_id = m.pair_id AND e.item = m.item AND side = CASE section WHEN '5_po_only' THEN 'po' ELSE 'invoice' END"))
def missing_items(spark, sf_dir):
    a = written(aligned(spark, sf_dir), "aligned")
    return _with_entries(spark, sf_dir, R.missing_items(a, R.fuzzy_matches(a)))


@query("f9_duplicate_items", with_ctes([*_INPUT, _groups("gi", "inv"), _groups("gp", "po"), DUPLICATES, ENTRIES], "SELECT d.pair_id, d.item, section, type, issue, entry_count, entries FROM duplicates d JOIN entries e ON e.pair_id = d.pair_id AND e.item = d.item AND side = CASE section WHEN '2_dup_po' THEN 'po' ELSE 'invoice' END"))
def duplicate_items(spark, sf_dir):
    inv, po = grouped(spark, sf_dir)
    return _with_entries(spark, sf_dir, R.duplicate_items(inv, "invoice").unionByName(R.duplicate_items(po, "po")))


@query("f10_discrepancies", with_ctes(FOUND_CTES, "SELECT * FROM found"))
def discrepancies(spark, sf_dir):
    return found(spark, sf_dir)


@query("f11_pair_summary", with_ctes(SUMMARY_CTES, "SELECT * FROM summary"))
def pair_summary(spark, sf_dir):
    return summary(spark, sf_dir)


@query("f12_confidence_flags", with_ctes([*FOUND_CTES, PAIRS, FLAGS], "SELECT * FROM flags"))
def confidence_flags(spark, sf_dir):
    return flags(spark, sf_dir).select("pair_id", F.array_join("confidence_flags", ",").alias("flags"))


@query("f13_pair_outcome", with_ctes([*_INPUT, _groups("gi", "inv"), _groups("gp", "po"), PAIRS, OUTCOME], "SELECT * FROM outcome"))
def pair_outcome(spark, sf_dir):
    return outcome(spark, sf_dir)


#: The failing pairs with their category and diagnostics.
FAILED = f"""failed AS (
  SELECT pair_id, error, warning, coalesce(nf, 0) AS nf,
    CASE WHEN error IS NOT NULL THEN 'execution_error' WHEN nf > 0 THEN 'reconciliation_mismatches' ELSE 'partial_extraction' END AS category,
    concat_ws(',', CASE WHEN error IS NOT NULL THEN 'execution_error,extraction_failed' END, CASE WHEN flags LIKE '%POSSIBLE_COLUMN_SHIFT%' THEN 'parser_instability' END,
      CASE WHEN flags LIKE '%RECONSTRUCTION%' AND rebuilt THEN 'reconstruction_overreach' END, CASE WHEN flags LIKE '%LOW_MATCH%' THEN 'fuzzy_matching_uncertainty' END,
      CASE WHEN drift THEN 'numeric_drift_patterns' END) AS diagnostics
  FROM outcome LEFT JOIN flags USING (pair_id) LEFT JOIN (
    SELECT pair_id, count(*) AS nf, bool_or(coalesce({drift_sql('invoice_num', 'po_num')}, false)) AS drift,
      bool_or((pair_id, item) IN (SELECT (pair_id, item) FROM inv WHERE reconstructed)) AS rebuilt FROM found GROUP BY 1) USING (pair_id)
  WHERE error IS NOT NULL OR nf > 0 OR warning IS NOT NULL)"""


def _failures(spark: SparkSession, sf_dir: str, once: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    inv, po = inputs.invoice_items(spark, sf_dir), inputs.marked_po_items(spark, sf_dir)
    a, f = once
    pairs, marks = inputs.pairs(spark, sf_dir), flags(spark, sf_dir, once)
    states = R.pair_outcome(pairs, a.where("inv_entry_count is not null"), a.where("po_entry_count is not null"))
    return R.classify_failures(pairs, states, marks, inv, po, f), states, marks


@query("f14_failures", with_ctes([*FOUND_CTES, PAIRS, FLAGS, OUTCOME, FAILED], "SELECT pair_id, category, diagnostics FROM failed"))
def failures(spark, sf_dir):
    out, _, _ = _failures(spark, sf_dir, _once(spark, sf_dir))
    return out.select("pair_id", "category", F.array_join("diagnostic_categories", ",").alias("diagnostics"))


@query("a9_failure_record", with_ctes([*FOUND_CTES, PAIRS, FLAGS, OUTCOME, FAILED], """SELECT pair_id, category, diagnostics, error, warning, coalesce(i.n, 0) AS invoice_item_count, coalesce(p.n, 0) AS po_item_count, nf AS discrepancies, g.flags
  FROM failed LEFT JOIN (SELECT pair_id, count(*) AS n FROM inv GROUP BY 1) i USING (pair_id) LEFT JOIN (SELECT pair_id, count(*) AS n FROM po GROUP BY 1) p USING (pair_id) LEFT JOIN flags g USING (pair_id)"""))
def failure_record(spark, sf_dir):
    """The failure log of all pairs, written by category and read back."""
    once = _once(spark, sf_dir)
    failed, states, marks = _failures(spark, sf_dir, once)
    side = lambda items, is_invoice: items.select("pair_id", F.lit(is_invoice).alias("is_invoice"))
    items = side(inputs.invoice_items(spark, sf_dir), True).unionByName(side(inputs.marked_po_items(spark, sf_dir), False))
    texts = inputs.pairs(spark, sf_dir).select("pair_id", F.lit(None).cast("string").alias("invoice_text"), F.lit(None).cast("string").alias("po_text"))
    record = files.failure_rows(written(failed, "failed"), texts, states, items, once[1], marks)
    path = f"{shared_folder(spark)}/failures-{uuid.uuid4().hex}"
    files.write_failures(record, path)
    back = spark.read.schema(record.schema).json(path)
    found = F.coalesce(F.size(F.from_json("discrepancies", "array<struct<type:string>>")), F.lit(0))
    return back.select(
        "pair_id", "category", F.array_join("diagnostic_categories", ",").alias("diagnostics"), "error", "warning", "invoice_item_count", "po_item_count",
        F.when(F.col("discrepancies").isNull(), 0).otherwise(found).alias("discrepancies"), F.array_join("confidence_flags", ",").alias("flags"),
    )


@query("c12_trailing_drift", with_ctes([PO], f"SELECT pair_id, line_no, {drift_sql('qty', '(qty + k)')} AS qty_drift, {drift_sql('price', '(price + k * 9)')} AS price_drift FROM po"))
def trailing_drift(spark, sf_dir):
    q, p, k = F.col("qty"), F.col("price"), F.col("k")
    return inputs.po_items(spark, sf_dir).select("pair_id", "line_no", is_trailing_drift(q, q + k).alias("qty_drift"), is_trailing_drift(p, p + k * 9).alias("price_drift"))


@query("c13_difference", "SELECT l_orderkey, l_partkey, l_linenumber, round(abs(l_quantity - CASE WHEN l_linenumber > 1 THEN l_extendedprice END), 2) AS difference FROM lineitem")
def differences(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", difference(F.col("l_quantity"), F.when(F.col("l_linenumber") > 1, F.col("l_extendedprice"))).alias("difference"))


@query("a8_report_rows", with_ctes([*FOUND_CTES, PAIRS, ENTRIES], """SELECT p.pair_id, CASE WHEN type IS NULL THEN '-' ELSE f.item END AS item, coalesce(field, '-') AS field,
    CASE WHEN type IS NULL THEN '-' WHEN section = '1_dup_invoice' THEN entry_count::VARCHAR WHEN section = '6_invoice_only' THEN entries ELSE coalesce(invoice_num::VARCHAR, 'N/A') END AS invoice,
    CASE WHEN type IS NULL THEN '-' WHEN section = '2_dup_po' THEN entry_count::VARCHAR WHEN section = '5_po_only' THEN entries ELSE coalesce(po_num::VARCHAR, 'N/A') END AS po,
    CASE WHEN type IS NULL THEN '-' ELSE coalesce(difference::VARCHAR, 'N/A') END AS difference, coalesce(replace(issue, '_', ' '), 'No discrepancies found') AS issue
  FROM pairs p LEFT JOIN found f ON f.pair_id = p.pair_id LEFT JOIN entries e ON e.pair_id = f.pair_id AND e.item = f.item AND section IN ('5_po_only', '6_invoice_only') AND side = CASE section WHEN '5_po_only' THEN 'po' ELSE 'invoice' END"""))
def report_rows(spark, sf_dir):
    rows = R.with_entries(written(found(spark, sf_dir), "found"), inputs.invoice_items(spark, sf_dir), inputs.marked_po_items(spark, sf_dir))
    return files.report_rows(rows, inputs.pairs(spark, sf_dir))


@query("a8_report_header", with_ctes(SUMMARY_CTES, "SELECT pair_id, status, discrepancies AS total_discrepancies, total_difference FROM summary"))
def report_header(spark, sf_dir):
    return files.report_header(summary(spark, sf_dir))


# --- from text to verdict ---------------------------------------------------------------------------------------------

#: The lines as they stand in the texts of both sides: the invoice's with noise that leaves the text readable.
NOISY = """noisy AS (
  SELECT pair_id, line_no, CASE WHEN k = 5 THEN replace(replace(item, 'hot', 'h0t'), 'rod', 'r0d') ELSE item END AS item, CASE k WHEN 1 THEN qty + 12 WHEN 2 THEN qty + 1 ELSE qty END AS qty,
    CASE k WHEN 3 THEN price + 1000 WHEN 4 THEN price + 9 ELSE price END AS price, total FROM po WHERE k <> 0)"""


def _read(name: str, source: str) -> str:
    """What the parser makes of the texts: a labelled order's totals are worked out, repeated rows of a document count once."""
    total = f"CASE WHEN pair_id % 3 = 1 THEN {half_up('qty * price')} ELSE total END"
    return f"""{name}_all AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, item, qty, price, amount ORDER BY line_no) AS nth FROM (SELECT *, {total} AS amount FROM {source})),
{name} AS (SELECT pair_id, line_no, item, qty, price, NULL::DOUBLE AS tax, amount AS total, false AS swapped, pair_id % 3 = 1 AS reconstructed FROM {name}_all WHERE nth = 1),
{name}_score AS (
  SELECT pair_id, round(CASE pair_id % 3 WHEN 0 THEN 0.98::DOUBLE WHEN 1 THEN 0.9::DOUBLE ELSE 0.72::DOUBLE END * 0.7::DOUBLE
      + count(*) FILTER (nth = 1)::DOUBLE / (count(*) + (pair_id % 3 = 0)::INT) * 0.3::DOUBLE, 4) AS score FROM {name}_all GROUP BY pair_id)"""


VERDICT = """verdict AS (
  SELECT pair_id, discrepancies, summary, total_difference, status, concat_ws(',', CASE WHEN coalesce(i.score, 0) < 0.65 OR coalesce(p.score, 0) < 0.65 THEN 'POSSIBLE_COLUMN_SHIFT' END,
      CASE WHEN pair_id % 3 = 1 THEN 'MATHEMATICAL_RECONSTRUCTION_USED' END, CASE WHEN flags LIKE '%LOW_MATCH%' THEN 'LOW_MATCH_CONFIDENCE' END) AS flags,
    CASE WHEN i.pair_id IS NULL THEN 'Invoice parser returned no line items; continuing reconciliation with PO items only. invoice_failure_reason=' || CASE WHEN pair_id % 3 = 0 THEN 'qty missing' ELSE 'no rows found' END END AS warning
  FROM summary JOIN flags USING (pair_id) LEFT JOIN inv_score i USING (pair_id) LEFT JOIN tpo_score p USING (pair_id))"""


def _two_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, invoice_text and po_text. An invoice without lines has only its heading and total."""
    po = inputs.po_items(spark, sf_dir)
    texts = inputs.written_orders(inputs.readable_invoice_items(po)).withColumnRenamed("text", "invoice_text")
    both = inputs.written_orders(po).withColumnRenamed("text", "po_text").join(texts, "doc_id", "left")
    nothing = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(inputs.HEADING), F.lit("\n"))).otherwise(""), F.lit("No position of this order has been invoiced"))
    return both.select(F.col("doc_id").alias("pair_id"), F.coalesce("invoice_text", nothing).alias("invoice_text"), "po_text")


@query("w1_text_to_verdict", with_ctes([PO, NOISY, _read("inv", "noisy"), _read("tpo", "po"), _groups("gi", "inv"), _groups("gp", "tpo"), ALIGNED, NEAR, SCORES, CANDS, GREEDY, MATCHED, COMPARED, MISSING, DUPLICATES, FOUND, PAIRS, SUMMARY, FLAGS, VERDICT], "SELECT *, NULL::VARCHAR AS error FROM verdict"))
def text_to_verdict(spark, sf_dir):
    out = verify_texts(_two_texts(spark, sf_dir))
    return out.select("pair_id", "discrepancies", "summary", "total_difference", "status", F.array_join("confidence_flags", ",").alias("flags"), "error", "warning")
