"""Reconciliation of the two sides of a document pair: group, align, compare, roll up.

Item tables have pair_id, line_no, item (normalized name), qty, price, and optionally swapped and reconstructed. Everything
is keyed by pair_id, so one hash partitioning by it serves most steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.matching import like_names
from ..functions.scalars import difference, is_trailing_drift, let, normalize_for_matching
from ..sources.tables import written
from .fuzzy_join import LARGE, assign_in_rounds, in_order, large_candidates

ITEM_MATCH_THRESHOLD = 85.0
PRICE_TOLERANCE = 0.0
ENTRY = "struct<line_no:int,item:string,qty:double,price:double>"


def group_items(items: DataFrame) -> DataFrame:
    """One row for each item name of a pair: entry_count, summed qty, whether any qty is known, the price if it is the only one.

    Rows with blank names drop out. Sums and extremes combine before the shuffle; entry lists are made apart (``entries``).
    """
    return (
        items.where(F.trim("item") != "")
        .groupBy("pair_id", "item")
        .agg(
            F.count("*").alias("entry_count"),
            F.coalesce(F.sum("qty"), F.lit(0.0)).alias("qty"),
            (F.count("qty") > 0).alias("has_qty"),
            F.when(F.min("price") == F.max("price"), F.min("price")).alias("price"),
        )
        .withColumn("has_duplicate", F.col("entry_count") > 1)
    )


def entries(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The entries, in line order, of the (pair_id, item) keys that need them only."""
    rows = items.join(keys.select("pair_id", "item"), ["pair_id", "item"], "left_semi")
    entry = F.struct(F.col("line_no").cast("int").alias("line_no"), "item", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"))
    return rows.groupBy("pair_id", "item").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def align_exact(invoice: DataFrame, po: DataFrame) -> DataFrame:
    """One full outer join of the groups of both sides gives the matched and both kinds of unmatched names; columns inv_* and po_*."""
    side = lambda df, p: df.select("pair_id", "item", *(F.col(c).alias(f"{p}_{c}") for c in ("qty", "has_qty", "price", "entry_count")))
    both = side(invoice, "inv").join(side(po, "po"), ["pair_id", "item"], "full")
    section = F.when(F.col("inv_entry_count").isNull(), "po_only").when(F.col("po_entry_count").isNull(), "invoice_only").otherwise("exact")
    return both.withColumn("section", section)


def align_items(invoice: DataFrame, po: DataFrame) -> DataFrame:
    """``align_exact`` of the groups of two item tables, in one aggregation: both sides are dealt by pair_id together, and what comes
    after finds them there."""
    side = lambda df, is_inv: df.select("pair_id", "item", F.col("qty").cast("double").alias("qty"), F.col("price").cast("double").alias("price"), F.lit(is_inv).alias("is_inv"))
    return align_sides(side(invoice, True).unionByName(side(po, False)))


def align_sides(items: DataFrame) -> DataFrame:
    """``align_items`` of one table of both sides' items: pair_id, item, qty, price and is_inv."""
    rows = items.where(F.trim("item") != "").repartition("pair_id")

    def of(p: str, mine: Column) -> list[Column]:
        qty, price = F.when(mine, F.col("qty")), F.when(mine, F.col("price"))
        n = F.count_if(mine)
        there = lambda c: F.when(n > 0, c)
        return [
            there(F.coalesce(F.sum(qty), F.lit(0.0))).alias(f"{p}_qty"), there(F.count(qty) > 0).alias(f"{p}_has_qty"),
            there(F.when(F.min(price) == F.max(price), F.min(price))).alias(f"{p}_price"), there(n).alias(f"{p}_entry_count"),
        ]

    both = rows.groupBy("pair_id", "item").agg(*of("inv", F.col("is_inv")), *of("po", ~F.col("is_inv")))
    section = F.when(F.col("inv_entry_count").isNull(), "po_only").when(F.col("po_entry_count").isNull(), "invoice_only").otherwise("exact")
    return both.withColumn("section", section)


def match_exact(invoice: DataFrame, po: DataFrame) -> DataFrame:
    return invoice.select("pair_id", "item").join(po.select("pair_id", "item"), ["pair_id", "item"], "inner")


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, ["pair_id", "item"], "left_anti")


def _by_pair(invoice: DataFrame, po: DataFrame) -> DataFrame:
    """One row for each pair that has names on both sides: arrays a and b of their names, ascending."""
    rows = invoice.select("pair_id", "item", F.lit(True).alias("is_inv")).unionByName(po.select("pair_id", "item", F.lit(False).alias("is_inv")))
    names = lambda mine: F.array_sort(F.collect_list(F.when(mine, F.col("item"))))
    return rows.groupBy("pair_id").agg(names(F.col("is_inv")).alias("a"), names(~F.col("is_inv")).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))


def _keys(names: Column) -> Column:
    return F.transform(names, normalize_for_matching)


def fuzzy_candidates(invoice: DataFrame, po: DataFrame, threshold: float = ITEM_MATCH_THRESHOLD, scorer: str = "token_set") -> DataFrame:
    """(pair_id, inv_item, po_item, score) of unmatched names of one pair whose score reaches the threshold.

    The names of a pair meet on one row; only names that a bound lets through are scored. For pairs of many names see ``large_candidates``.
    """
    found = _by_pair(invoice, po).withColumn("m", like_names(threshold, scorer)(_keys(F.col("a")), _keys(F.col("b"))))
    pairs = F.transform("m", lambda m: F.struct(F.get("a", m["a"]).alias("inv_item"), F.get("b", m["b"]).alias("po_item"), m["score"].alias("score")))
    return found.select("pair_id", F.explode(pairs).alias("c")).select("pair_id", "c.*")


def assign_greedy(candidates: DataFrame) -> DataFrame:
    """One-to-one matches: invoice names ascending, each takes its best free PO name (ties: the smaller name). For large pairs see ``assign_in_rounds``."""
    return in_order(candidates)


def _matched_rows(rest: DataFrame, threshold: float, scorer: str) -> DataFrame:
    """One row for each pair: the unmatched groups of both sides as arrays a and b by name, and m: the numbers of those that match, one to one."""
    group = lambda p: F.struct("item", *(F.col(f"{p}_{c}") for c in ("qty", "has_qty", "price", "entry_count")))
    side = lambda p, s: F.array_sort(F.collect_list(F.when(F.col("section") == s, group(p))))
    pairs = rest.groupBy("pair_id").agg(side("inv", "invoice_only").alias("a"), side("po", "po_only").alias("b"))
    names = lambda c: _keys(F.transform(c, lambda x: x["item"]))
    found = like_names(threshold, scorer, greedy=True)(names(F.col("a")), names(F.col("b")))
    return pairs.withColumn("m", found)


def compare_values(matched: DataFrame, tolerance: float = PRICE_TOLERANCE) -> DataFrame:
    """Add qty_check and price_check to matched rows: none, suppressed, review or mismatch.

    A suppressed quantity hides the price check as well.
    """
    iq, pq, ip, pp = (F.col(c) for c in ("inv_qty", "po_qty", "inv_price", "po_price"))
    both = F.col("inv_has_qty") & F.col("po_has_qty")
    qd, pd_ = F.abs(iq - pq), F.abs(ip - pp)
    qty = F.when(~both | (iq == pq), "none").when(is_trailing_drift(iq, pq), F.when(qd <= 1, "suppressed").otherwise("review")).otherwise("mismatch")
    small = (pd_ <= 1.0) | (F.coalesce(F.try_divide(pd_, F.greatest(ip, pp)), F.lit(1.0)) < 0.01)
    price = (
        F.when(F.col("qty_check") == "suppressed", "none")
        .when(ip.isNull() | pp.isNull() | (ip == pp), "none")
        .when((F.lit(tolerance) > 0) & (pd_ <= tolerance), "none")
        .when(is_trailing_drift(ip, pp), F.when(small, "suppressed").otherwise("review"))
        .otherwise("mismatch")
    )
    return matched.withColumn("qty_check", qty).withColumn("price_check", price)


def _value_rows() -> list[Column]:
    """What a compared row tells of its quantity and of its price; null where these agree."""

    def row(field: str, rank: int, kind: str, a: str, b: str, check: str) -> Column:
        review = F.col(check) == "review"
        return F.when(
            F.col(check).isin("review", "mismatch"),
            F.struct(
                F.lit(kind).alias("type"),
                F.lit(field).alias("field"),
                F.lit(rank).alias("field_rank"),
                F.col(a).alias("invoice_num"),
                F.col(b).alias("po_num"),
                difference(F.col(a), F.col(b)).alias("difference"),
                F.concat(F.lit(f"{field} mismatch"), F.when(review, " (probable OCR noise)").otherwise("")).alias("issue"),
                review.alias("review_required"),
            ),
        )

    return [row("quantity", 0, "quantity_mismatch", "inv_qty", "po_qty", "qty_check"), row("price", 1, "price_mismatch", "inv_price", "po_price", "price_check")]


def value_discrepancies(compared: DataFrame) -> DataFrame:
    """Up to two rows, quantity and price, for each matched row that does not agree."""
    both = F.array_compact(F.array(*_value_rows()))
    return compared.select("pair_id", "item", "section", F.explode(both).alias("d")).select("pair_id", "item", "section", "d.*")


def _flat(groups: DataFrame, section: str, kind: str, field: str, issue: str) -> DataFrame:
    return groups.select(
        "pair_id", "item", F.lit(section).alias("section"), F.lit(kind).alias("type"), F.lit(field).alias("field"), F.lit(0).alias("field_rank"),
        F.lit(None).cast("double").alias("invoice_num"), F.lit(None).cast("double").alias("po_num"), F.lit(None).cast("double").alias("difference"),
        F.lit(issue).alias("issue"), F.lit(False).alias("review_required"), F.col("entry_count").cast("long").alias("entry_count"),
    )


def missing_items(aligned: DataFrame, matches: DataFrame) -> DataFrame:
    """Names of one side that neither an exact nor a fuzzy match has."""
    inv = aligned.where("section = 'invoice_only'").join(matches.select("pair_id", F.col("inv_item").alias("item")), ["pair_id", "item"], "left_anti")
    po = aligned.where("section = 'po_only'").join(matches.select("pair_id", F.col("po_item").alias("item")), ["pair_id", "item"], "left_anti")
    return _missing(po.withColumn("entry_count", F.col("po_entry_count")), "po").unionByName(_missing(inv.withColumn("entry_count", F.col("inv_entry_count")), "invoice"))


def _missing(groups: DataFrame, side: str) -> DataFrame:
    if side == "po":
        return _flat(groups, "5_po_only", "missing_in_invoice", "item", "missing in invoice")
    return _flat(groups, "6_invoice_only", "missing_in_po", "item", "missing in PO")


def duplicate_items(groups: DataFrame, side: str) -> DataFrame:
    """Names that a side has more than once."""
    section = {"invoice": "1_dup_invoice", "po": "2_dup_po"}[side]
    return _flat(groups.where("has_duplicate"), section, "duplicate_item", "item", f"duplicate item in {side}")


def with_entries(found: DataFrame, invoice: DataFrame, po: DataFrame) -> DataFrame:
    """Add ``entries``: the lines, in their order, behind each missing or duplicate item, of the side that has it; null for other rows.

    Only the lines of such names are gathered; a name's lines are one row.
    """
    side = F.when(F.col("section").isin("1_dup_invoice", "6_invoice_only"), "invoice").when(F.col("section").isin("2_dup_po", "5_po_only"), "po")
    found = found.withColumn("side", side)
    keys = found.where("side is not null").select("pair_id", "item", "side").distinct()
    of = lambda items, name: entries(items, keys.where(F.col("side") == name)).withColumn("side", F.lit(name))
    return found.join(of(invoice, "invoice").unionByName(of(po, "po")), ["pair_id", "item", "side"], "left").drop("side")


def fuzzy_matches(aligned: DataFrame, threshold: float = ITEM_MATCH_THRESHOLD, scorer: str = "token_set") -> DataFrame:
    candidates = fuzzy_candidates(aligned.where("section = 'invoice_only'"), aligned.where("section = 'po_only'"), threshold, scorer)
    return assign_greedy(candidates)


def matched_pairs(aligned: DataFrame, matches: DataFrame) -> DataFrame:
    """Exact and fuzzy matches with the amounts of both sides; fuzzy rows carry the invoice's name."""
    exact = aligned.where("section = 'exact'").withColumn("section", F.lit("3_exact"))
    inv = aligned.where("section = 'invoice_only'").select("pair_id", F.col("item").alias("inv_item"), "inv_qty", "inv_has_qty", "inv_price", "inv_entry_count")
    po = aligned.where("section = 'po_only'").select("pair_id", F.col("item").alias("po_item"), "po_qty", "po_has_qty", "po_price", "po_entry_count")
    fuzzy = matches.select("pair_id", "inv_item", "po_item").join(inv, ["pair_id", "inv_item"]).join(po, ["pair_id", "po_item"])
    return exact.unionByName(fuzzy.withColumn("item", F.col("inv_item")).withColumn("section", F.lit("4_fuzzy")).drop("inv_item", "po_item"))


def discrepancies_of(aligned: DataFrame, tolerance: float = PRICE_TOLERANCE, threshold: float = ITEM_MATCH_THRESHOLD, scorer: str = "token_set") -> DataFrame:
    """All discrepancy rows of aligned groups. Order them by section, item, field_rank within a pair.

    What one side only has meets on one row for each pair, where it is matched, compared and told missing; nothing is joined back.
    For tables in which a pair may have many names see ``discrepancies_at_any_size``.
    """
    groups = ("qty", "has_qty", "price", "entry_count")
    pairs = _matched_rows(aligned.where("section <> 'exact'"), threshold, scorer)
    kinds = {"qty": "double", "has_qty": "boolean", "price": "double", "entry_count": "long"}
    part = lambda x, p: [(F.lit(None) if x is None else x[f"{p}_{c}"]).cast(kinds[c]).alias(f"{p}_{c}") for c in groups]
    row = lambda item, x, y, section: F.struct(item.alias("item"), *part(x, "inv"), *part(y, "po"), F.lit(section).alias("section"))
    fuzzy = F.transform("m", lambda m: let(F.struct(F.get("a", m["a"]).alias("x"), F.get("b", m["b"]).alias("y")), lambda t: row(t["x"]["item"], t["x"], t["y"], "4_fuzzy")))
    free = lambda c: let(F.transform("m", lambda m: m[c]), lambda taken: F.filter(c, lambda x, i: ~F.array_contains(taken, i)))
    left = [F.transform(free("b"), lambda x: row(x["item"], None, x, "5_po_only")), F.transform(free("a"), lambda x: row(x["item"], x, None, "6_invoice_only"))]
    # the rest of a pair is read once: what matches, and what is missing on either side
    of_pairs = pairs.select("pair_id", F.explode(F.concat(fuzzy, *left)).alias("t")).select("pair_id", "t.*", F.lit(False).alias("is_group"))
    of_groups = aligned.where("section = 'exact' OR inv_entry_count > 1 OR po_entry_count > 1").withColumn("section", F.when(F.col("section") == "exact", "3_exact").otherwise("")).withColumn("is_group", F.lit(True))
    return _told(compare_values(of_groups.unionByName(of_pairs), tolerance))


def _told(rows: DataFrame) -> DataFrame:
    """All that compared rows tell: of groups (``is_group``) the names a side has more than once, of matched rows amounts, of others that they are missing."""
    none, count = F.lit(None).cast("double"), lambda c: F.col(c).cast("long")

    def flat(cond: Column, section: str, kind: str, issue: str, n: Column) -> Column:
        texts = [F.lit(x).alias(k) for k, x in (("section", section), ("type", kind), ("field", "item"))]
        numbers = [none.alias(k) for k in ("invoice_num", "po_num", "difference")]
        return F.when(cond, F.struct(*texts, F.lit(0).alias("field_rank"), *numbers, F.lit(issue).alias("issue"), F.lit(False).alias("review_required"), n.alias("entry_count")))

    def value(d: Column) -> Column:
        names = ("type", "field", "field_rank", "invoice_num", "po_num", "difference", "issue", "review_required")
        return F.when(F.col("section").isin("3_exact", "4_fuzzy") & d.isNotNull(), F.struct(F.col("section"), *(d[k].alias(k) for k in names), F.lit(None).cast("long").alias("entry_count")))

    twice = lambda c: F.col("is_group") & (F.coalesce(count(c), F.lit(0)) > 1)
    alone = lambda s: ~F.col("is_group") & (F.col("section") == s)
    found = F.array(
        flat(twice("inv_entry_count"), "1_dup_invoice", "duplicate_item", "duplicate item in invoice", count("inv_entry_count")),
        flat(twice("po_entry_count"), "2_dup_po", "duplicate_item", "duplicate item in po", count("po_entry_count")),
        *(value(d) for d in _value_rows()),
        flat(alone("5_po_only"), "5_po_only", "missing_in_invoice", "missing in invoice", count("po_entry_count")),
        flat(alone("6_invoice_only"), "6_invoice_only", "missing_in_po", "missing in PO", count("inv_entry_count")),
    )
    return rows.select("pair_id", "item", F.explode(F.array_compact(found)).alias("d")).select("pair_id", "item", "d.*")


def discrepancies_at_any_size(aligned: DataFrame, tolerance: float = PRICE_TOLERANCE, threshold: float = ITEM_MATCH_THRESHOLD, large: int = LARGE) -> DataFrame:
    """``discrepancies_of`` for written groups: pairs whose unmatched names have more than ``large`` combinations stay in rows, their names are searched and
    assigned over tasks (``fuzzy_join``). Whether there are any is looked up first, so that tables without them have the plan of rows a pair."""
    sizes = aligned.groupBy("pair_id").agg((F.count_if(F.col("section") == "invoice_only") * F.count_if(F.col("section") == "po_only") > large).alias("large")).where("large")
    if not sizes.limit(1).count():
        return discrepancies_of(aligned, tolerance, threshold)
    of_large = aligned.join(sizes, "pair_id", "left").fillna(False, ["large"])
    few, many = of_large.where("not large").drop("large"), written(of_large.where("large").drop("large"), "large-pairs")
    matches = written(assign_in_rounds(large_candidates(many.where("section = 'invoice_only'"), many.where("section = 'po_only'"), threshold)), "large-matches")
    twice = lambda p, name: duplicate_items(many.where(f"{p}_entry_count > 1").select("pair_id", "item", F.lit(True).alias("has_duplicate"), F.col(f"{p}_entry_count").alias("entry_count")), name)
    values = value_discrepancies(compare_values(matched_pairs(many, matches), tolerance)).withColumn("entry_count", F.lit(None).cast("long"))
    return discrepancies_of(few, tolerance, threshold).unionByName(values).unionByName(missing_items(many, matches)).unionByName(twice("inv", "invoice")).unionByName(twice("po", "po"))


def discrepancies(invoice: DataFrame, po: DataFrame, tolerance: float = PRICE_TOLERANCE, threshold: float = ITEM_MATCH_THRESHOLD, scorer: str = "token_set") -> DataFrame:
    """All discrepancy rows of grouped sides."""
    return discrepancies_of(align_exact(invoice, po), tolerance, threshold, scorer)


def summarize_pairs(pairs: DataFrame, found: DataFrame, issues: bool = False) -> DataFrame:
    """Verdict of every pair, those without discrepancies too; with ``issues`` the fields found as well, of the same pass."""
    more = [F.array_sort(F.collect_list("field")).alias("issues")] if issues else []
    sums = found.groupBy("pair_id").agg(F.count("*").alias("n"), F.round(F.sum("difference"), 2).alias("d"), *more)
    n = F.coalesce("n", F.lit(0))
    return pairs.join(sums, "pair_id", "left").select(
        *pairs.columns,
        n.alias("discrepancies"),
        F.when(n > 0, F.concat(n.cast("string"), F.lit(" discrepancy(s) found."))).otherwise("No discrepancies found.").alias("summary"),
        F.coalesce("d", F.lit(0.0)).alias("total_difference"),
        F.when(n > 0, "Discrepancies Found").otherwise("No Discrepancies Found").alias("status"),
        *(["issues"] if issues else []),
    )


def confidence_flags(pairs: DataFrame, invoice_items: DataFrame, po_items: DataFrame, aligned: DataFrame, found: DataFrame) -> DataFrame:
    """confidence_flags of every pair. ``pairs`` may have invoice_confidence, po_confidence, fallback_used, invoice_score, po_score."""
    col = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in pairs.columns else F.lit(d)
    items = invoice_items.select("pair_id", "swapped", "reconstructed").unionByName(po_items.select("pair_id", "swapped", "reconstructed"))
    marks = items.groupBy("pair_id").agg(F.bool_or("swapped").alias("swapped"), F.bool_or("reconstructed").alias("reconstructed"))
    names = aligned.groupBy("pair_id").agg(
        F.count("inv_entry_count").alias("n_inv"), F.count("po_entry_count").alias("n_po"), F.count(F.when(F.col("section") != "exact", 1)).alias("n_unmatched")
    )
    counts = found.groupBy("pair_id").agg(F.count("*").alias("n_found"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = zero("n_unmatched") / (F.greatest(zero("n_inv"), F.lit(1)) + F.greatest(zero("n_po"), F.lit(1)))
    flag = lambda cond, name: F.when(cond, name)
    flags = F.array_compact(
        F.array(
            flag((col("invoice_confidence", 1.0) < 0.65) | (col("po_confidence", 1.0) < 0.65), "LOW_CONFIDENCE_OCR"),
            flag(col("fallback_used", False), "OCR_FALLBACK_TRIGGERED"),
            flag(F.coalesce("swapped", F.lit(False)) | (col("invoice_score", 1.0) < 0.65) | (col("po_score", 1.0) < 0.65), "POSSIBLE_COLUMN_SHIFT"),
            flag(F.coalesce("reconstructed", F.lit(False)), "MATHEMATICAL_RECONSTRUCTION_USED"),
            flag((share > 0.35) | (zero("n_found") > 2), "LOW_MATCH_CONFIDENCE"),
        )
    )
    joined = pairs.join(marks, "pair_id", "left").join(names, "pair_id", "left").join(counts, "pair_id", "left")
    return joined.select("pair_id", flags.alias("confidence_flags"))


def pair_outcome(pairs: DataFrame, invoice: DataFrame, po: DataFrame) -> DataFrame:
    """error where neither side has items; warning where one has none. ``pairs`` may have invoice_failure and po_failure."""
    ni = invoice.groupBy("pair_id").agg(F.count("*").alias("n_invoice"))
    np_ = po.groupBy("pair_id").agg(F.count("*").alias("n_po"))
    reason = lambda c: F.coalesce(F.col(c), F.lit("None")) if c in pairs.columns else F.lit("None")
    joined = pairs.join(ni, "pair_id", "left").join(np_, "pair_id", "left")
    none_i, none_p = F.col("n_invoice").isNull(), F.col("n_po").isNull()
    warning = F.when(none_i & ~none_p, F.concat(F.lit("Invoice parser returned no line items; continuing reconciliation with PO items only. invoice_failure_reason="), reason("invoice_failure"))).when(
        none_p & ~none_i, F.concat(F.lit("PO parser returned no line items; continuing reconciliation with invoice items only. po_failure_reason="), reason("po_failure"))
    )
    return joined.select("pair_id", F.when(none_i & none_p, "Could not parse structured invoice line items from OCR text.").alias("error"), warning.alias("warning"))


def classify_failures(pairs: DataFrame, outcome: DataFrame, flags: DataFrame, invoice_items: DataFrame, po_items: DataFrame, found: DataFrame) -> DataFrame:
    """category and diagnostic_categories of failing pairs; a pair without failure has no row."""
    items = invoice_items.select("pair_id", "item", "reconstructed").unionByName(po_items.select("pair_id", "item", "reconstructed"))
    tax_words = ["cgst", "sgst", "igst", "utgst", "vat", "gst", "tax", "total", "subtotal"]
    taxed = F.lit(False)
    for w in tax_words:
        taxed = taxed | F.lower("item").contains(w)
    per_items = items.groupBy("pair_id").agg(F.count("*").alias("n_items"), F.bool_or(taxed).alias("gst"))
    rebuilt = items.where("reconstructed").select("pair_id", "item").distinct()
    over = found.join(rebuilt, ["pair_id", "item"], "left_semi").select("pair_id").distinct().withColumn("over", F.lit(True))
    drift = F.coalesce(is_trailing_drift(F.col("invoice_num"), F.col("po_num")), F.lit(False))
    per_found = found.groupBy("pair_id").agg(F.count("*").alias("n_found"), F.bool_or(drift).alias("drift"))
    j = pairs.select("pair_id").join(outcome, "pair_id", "left").join(flags, "pair_id", "left").join(per_items, "pair_id", "left").join(over, "pair_id", "left").join(per_found, "pair_id", "left")
    empty = F.col("n_items").isNull()
    has = lambda f: F.array_contains("confidence_flags", f)
    category = (
        F.when(F.col("error").isNotNull(), "execution_error").when(empty, "extraction_failed").when(F.col("n_found") > 0, "reconciliation_mismatches").when(F.col("warning").isNotNull(), "partial_extraction")
    )
    diagnostics = F.array_compact(
        F.array(
            F.when(F.col("error").isNotNull(), "execution_error"),
            F.when(empty, "extraction_failed"),
            F.when(has("LOW_CONFIDENCE_OCR") | has("OCR_FALLBACK_TRIGGERED"), "ocr_corruption_patterns"),
            F.when(has("POSSIBLE_COLUMN_SHIFT"), "parser_instability"),
            F.when(has("MATHEMATICAL_RECONSTRUCTION_USED") & F.col("over"), "reconstruction_overreach"),
            F.when(has("LOW_MATCH_CONFIDENCE"), "fuzzy_matching_uncertainty"),
            F.when(F.col("gst"), "gst_tax_contamination"),
            F.when(F.col("drift"), "numeric_drift_patterns"),
        )
    )
    return j.select("pair_id", category.alias("category"), diagnostics.alias("diagnostic_categories")).where(F.col("category").isNotNull())
