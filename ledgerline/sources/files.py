"""Sources, gates and sinks of documents, histories and reports."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import entry_text, preview, strip

MAX_UPLOAD_BYTES = 10 * 1024 * 1024
HISTORY = "id string, vendor string, status string, discrepancies int, time timestamp, rupeeDifference double, duration string, confidence string, issues array<string>"


def on_disk(spark: SparkSession, path: str) -> str | None:
    """The folder of a path that is on a disk which all tasks see; null where only Spark's own readers and writers come to it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return there.getPath() if there.getScheme() == "file" else None


def write_each(rows: DataFrame, folder: str) -> int:
    """Write each row of name and content as a file of its own in a folder on a disk that all tasks see; gives their number.

    Names may have folders in them. Spark's writers give a file a folder, a checksum and a mode of its own, where each mode is set by a program that is
    started for it; here tasks write theirs in place, and a repeated task replaces what the one before has written.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.join(folder, name)
                top, file = os.path.split(path)
                if top not in made:
                    os.makedirs(top, exist_ok=True)
                    made.add(top)
                # hidden from readers until it is whole
                young = os.path.join(top, f".{file}.{os.getpid()}")
                with open(young, "wb") as out:
                    out.write(content)
                os.replace(young, path)
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return rows.select("name", F.col("content").cast("binary")).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of each file; the source leaves out files of no bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and text of text files; bytes that are no UTF-8 are replaced."""
    return read_uploads(spark, path).where(F.lower("path").endswith(".txt")).select(F.col("path").alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def gate_uploads(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Add reject_reason, by the first rule that fails; null where the file may come in."""
    low = F.lower("path")
    is_pdf = low.endswith(".pdf")
    reason = (
        F.when(F.col("path").isNull() | (F.col("path") == ""), "missing file")
        .when(~is_pdf & ~low.endswith(".txt"), "unsupported file type")
        .when(F.coalesce("length", F.lit(0)) == 0, "empty file")
        .when(F.col("length") > max_bytes, "file too large")
        .when(is_pdf & ~F.coalesce(F.substring("content", 1, 4) == F.lit(b"%PDF"), F.lit(False)), "not a PDF")
    )
    return files.withColumn("reject_reason", reason)


def gate_min_text(pairs: DataFrame, min_len: int = 40) -> DataFrame:
    """Add error for pairs with too little text on a side; the invoice is looked at first. ``pairs``: invoice_text, po_text."""
    short = lambda c: F.length(strip(F.coalesce(F.col(c), F.lit("")))) < min_len
    return pairs.withColumn("error", F.when(short("invoice_text"), "invoice text is too short").when(short("po_text"), "PO text is too short"))


def classify_docs(pages: DataFrame, engines: tuple[str, str] = ("text_a", "text_b")) -> DataFrame:
    """pdf_type of each document from the text that two extractors found on its pages: the longer one counts, the second where equal."""
    one = lambda c: F.array_sort(F.collect_list(F.struct("page_number", F.trim(F.coalesce(F.col(c), F.lit(""))).alias("t"))))
    docs = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), one(engines[0]).alias("a"), one(engines[1]).alias("b"))
    text = lambda c: F.array_join(F.transform(F.filter(c, lambda x: x["t"] != ""), lambda x: x["t"]), "\n")
    docs = docs.withColumn("a", text("a")).withColumn("b", text("b"))
    docs = docs.withColumn("text", strip(F.when(F.length("b") >= F.length("a"), F.col("b")).otherwise(F.col("a"))))
    n, avg = F.length("text"), F.length("text") / F.col("page_count")
    return docs.select("doc_id", "page_count", n.alias("text_length"), F.round(avg, 2).alias("avg_chars_per_page"), pdf_type(n, avg).alias("pdf_type"), F.substring("text", 1, 500).alias("text_preview"))


def pdf_type(n: Column, avg: Column) -> Column:
    """unknown without pages (null), scanned with too little text, else text."""
    return F.when(n.isNull() | avg.isNull(), "unknown").when((n < 60) | (avg < 20), "scanned").otherwise("text")


def flatten_table_rows(tables: DataFrame) -> DataFrame:
    """doc_id and text of tables: cells by ' | ', rows by lines; blank cells and rows drop out. ``tables``: doc_id, row_no, cells."""
    cells = F.filter(F.transform("cells", lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))
    rows = tables.select("doc_id", "row_no", F.array_join(cells, " | ").alias("line")).where("line <> ''")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("r")).select("doc_id", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Runs from a JSON array of history items."""
    raw = spark.read.schema(HISTORY).json(path, multiLine=True)
    return raw.select(F.col("id").alias("run_id"), "vendor", "status", F.coalesce("discrepancies", F.lit(0)).alias("discrepancies"), F.col("time").alias("ts"), F.col("rupeeDifference").alias("rupee_difference"), "duration", "confidence", "issues")


def report_rows(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the discrepancy report, one placeholder for a pair without any.

    A duplicate item shows how many lines its side has, a missing one the lines themselves; ``found`` without section, entry_count or entries has N/A there.
    """
    for c, kind in (("section", "string"), ("entry_count", "long"), ("entries", "array<struct<line_no:int,item:string,qty:double,price:double>>")):
        found = found if c in found.columns else found.withColumn(c, F.lit(None).cast(kind))
    j = pairs.select("pair_id").join(found, "pair_id", "left")
    none = F.col("type").isNull()
    shown = lambda c, d: F.when(none, "-").otherwise(F.coalesce(F.col(c).cast("string"), F.lit(d)))
    lines = entry_text(F.col("entries"))

    def side(c: str, twice: str, only: str) -> Column:
        return F.when(F.col("section") == twice, F.col("entry_count").cast("string")).when(F.col("section") == only, F.coalesce(lines, F.lit("N/A"))).otherwise(shown(c, "N/A"))

    return j.select(
        "pair_id", shown("item", "-").alias("item"), shown("field", "-").alias("field"), side("invoice_num", "1_dup_invoice", "6_invoice_only").alias("invoice"), side("po_num", "2_dup_po", "5_po_only").alias("po"),
        shown("difference", "N/A").alias("difference"), F.when(none, "No discrepancies found").otherwise(F.replace("issue", F.lit("_"), F.lit(" "))).alias("issue"),
    )


def report_header(summary: DataFrame) -> DataFrame:
    return summary.select("pair_id", "status", F.col("discrepancies").alias("total_discrepancies"), "total_difference")


def write_report(rows: DataFrame, path: str, kind: str = "csv") -> None:
    (rows.write.option("header", "true") if kind == "csv" else rows.write).format(kind).mode("errorifexists").save(path)


def failure_rows(failures: DataFrame, texts: DataFrame, outcome: DataFrame | None = None, items: DataFrame | None = None, found: DataFrame | None = None, flags: DataFrame | None = None, parsers: DataFrame | None = None) -> DataFrame:
    """The record of each failing pair: category, lengths and previews of both texts, and an id of its own. ``texts``: pair_id, invoice_text, po_text.

    With them, also error and warning (``outcome``), counts of items (``items``: pair_id, is_invoice), the discrepancies as one JSON
    text (``found``, by section, item and field), confidence flags (``flags``) and what the parser reports of both sides (``parsers``: pair_id,
    is_invoice, score, failure_reason); null where a table is not given.
    """
    rows = failures.join(texts, "pair_id", "left")
    null = lambda kind: F.lit(None).cast(kind)
    rows = rows.join(outcome.select("pair_id", "error", "warning"), "pair_id", "left") if outcome is not None else rows.withColumns({"error": null("string"), "warning": null("string")})
    if items is not None:
        counts = items.groupBy("pair_id").agg(F.count_if("is_invoice").alias("invoice_item_count"), F.count_if(~F.col("is_invoice")).alias("po_item_count"))
        rows = rows.join(counts, "pair_id", "left").fillna(0, ["invoice_item_count", "po_item_count"])
    else:
        rows = rows.withColumns({"invoice_item_count": null("long"), "po_item_count": null("long")})
    if found is not None:
        some = F.struct("section", "item", "field_rank", "type", "field", F.col("invoice_num").alias("invoice_value"), F.col("po_num").alias("po_value"), "difference", "issue")
        rows = rows.join(found.groupBy("pair_id").agg(F.to_json(F.array_sort(F.collect_list(some))).alias("discrepancies")), "pair_id", "left")
    else:
        rows = rows.withColumn("discrepancies", null("string"))
    rows = rows.join(flags.select("pair_id", "confidence_flags"), "pair_id", "left") if flags is not None else rows.withColumn("confidence_flags", null("array<string>"))
    report = "struct<score:double,failure_reason:string>"
    if parsers is not None:
        mine = lambda side: F.max(F.when(side, F.struct(F.col("score").cast("double").alias("score"), "failure_reason")))
        rows = rows.join(parsers.groupBy("pair_id").agg(mine(F.col("is_invoice")).alias("invoice_parser"), mine(~F.col("is_invoice")).alias("po_parser")), "pair_id", "left")
    else:
        rows = rows.withColumns({"invoice_parser": null(report), "po_parser": null(report)})
    length = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    return rows.select(
        F.uuid().alias("failure_id"), F.current_timestamp().alias("timestamp"), "pair_id", "category", "diagnostic_categories", "error", "warning",
        length("invoice_text").alias("invoice_text_length"), length("po_text").alias("po_text_length"), "invoice_item_count", "po_item_count", "discrepancies", "invoice_parser", "po_parser", "confidence_flags",
        preview(F.col("invoice_text"), 1000).alias("invoice_preview"), preview(F.col("po_text"), 1000).alias("po_preview"),
    )


def write_failures(rows: DataFrame, path: str) -> None:
    """JSON by category. Rows stay in their tasks, which each write a file for a category they hold; merge tasks before, if they are small."""
    rows.write.partitionBy("category").mode("append").json(path)
