"""From the texts of document pairs to their verdicts: parse both sides, reconcile, flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import gate_min_text
from ..sources.tables import written
from .line_items import structured_documents
from .reconcile import align_items, confidence_flags, discrepancies_at_any_size, pair_outcome, summarize_pairs

MIN_TEXT = 40


def parsed_pairs(texts: DataFrame, min_len: int = MIN_TEXT) -> DataFrame:
    """One row for each document that is long enough on both sides: pair_id, is_invoice, and what the parser made of it.

    It is written once, as the steps of a verdict read it several times. ``texts``: pair_id, invoice_text, po_text.
    """
    usable = gate_min_text(texts, min_len).where("error is null")
    side = lambda is_invoice, text: F.struct(F.struct("pair_id", F.lit(is_invoice).alias("is_invoice")).alias("doc_id"), F.col(text).alias("text"))
    docs = usable.select(F.explode(F.array(side(True, "invoice_text"), side(False, "po_text"))).alias("d")).select("d.*")
    return written(structured_documents(docs, dictionary=True).select("doc_id.pair_id", "doc_id.is_invoice", "line_items", "score", "failure_reason"), "parsed-pairs")


def verify_texts(texts: DataFrame, min_len: int = MIN_TEXT) -> DataFrame:
    """Verdict of every pair: discrepancies, summary, total_difference, status, confidence_flags, error and warning.

    A pair with too short a text on a side has that as its error, and no verdict on items.
    """
    parsed = parsed_pairs(texts, min_len)
    items = parsed.select("pair_id", "is_invoice", F.explode("line_items").alias("i")).select("pair_id", "is_invoice", "i.*")
    invoice, po = items.where("is_invoice"), items.where("not is_invoice")
    # each is read by several of the steps below
    aligned = written(align_items(invoice, po), "aligned")
    found = written(discrepancies_at_any_size(aligned), "found")
    one = lambda c, mine, name: F.max(F.when(F.col("is_invoice") == mine, F.col(c))).alias(name)
    pairs = parsed.groupBy("pair_id").agg(one("score", True, "invoice_score"), one("score", False, "po_score"), one("failure_reason", True, "invoice_failure"), one("failure_reason", False, "po_failure"))
    groups = lambda p: aligned.where(f"{p}_entry_count is not null")
    verdicts = summarize_pairs(pairs, found).join(confidence_flags(pairs, invoice, po, aligned, found), "pair_id").join(pair_outcome(pairs, groups("inv"), groups("po")), "pair_id")
    short = gate_min_text(texts, min_len).select("pair_id", F.col("error").alias("too_short"))
    out = short.join(verdicts, "pair_id", "left")
    return out.select("pair_id", "discrepancies", "summary", "total_difference", "status", "confidence_flags", F.coalesce("too_short", "error").alias("error"), "warning")
