import json

from pyspark.sql import functions as F

from ledgerline.sources import files, tables


def test_text_documents_and_the_upload_gate(spark, tmp_path):
    for name, content in {"a.txt": b"plain text", "b.TXT": b"bad \xff byte", "c.pdf": b"%PDF-1.4 x", "d.pdf": b"no pdf", "e.csv": b"x", "f.txt": b"", "g.txt": b"x" * 50}.items():
        (tmp_path / name).write_bytes(content)
    # a file of no bytes has no row
    uploads = files.read_uploads(spark, str(tmp_path))
    reasons = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in files.gate_uploads(uploads, max_bytes=40).collect()}
    assert reasons == {"a.txt": None, "b.TXT": None, "c.pdf": None, "d.pdf": "not a PDF", "e.csv": "unsupported file type", "g.txt": "file too large"}
    docs = {r.doc_id.rsplit("/", 1)[1]: r.text for r in files.read_text_docs(spark, str(tmp_path)).collect()}
    assert docs == {"a.txt": "plain text", "b.TXT": "bad � byte", "g.txt": "x" * 50}


def test_gate_rules_in_order_and_missing_parts(spark):
    rows = [(None, 5, b"%PDF"), ("", 5, b"%PDF"), ("x.doc", 0, b""), ("x.pdf", None, None), ("x.pdf", 4, None), ("x.pdf", 99, b"%PDF")]
    made = [r.reject_reason for r in files.gate_uploads(spark.createDataFrame(rows, "path string, length long, content binary"), 50).collect()]
    assert made == ["missing file", "missing file", "unsupported file type", "empty file", "not a PDF", "file too large"]


def test_min_text_looks_at_the_invoice_first(spark):
    rows = [("x" * 50, "y" * 50), (" x ", "y"), ("x" * 50, None), (None, None)]
    made = [r.error for r in files.gate_min_text(spark.createDataFrame(rows, "invoice_text string, po_text string")).collect()]
    assert made == [None, "invoice text is too short", "PO text is too short", "invoice text is too short"]


def test_history(spark, tmp_path):
    runs = [{"id": "r1", "vendor": "V", "status": "s", "discrepancies": 2, "time": "2024-01-02T03:04:05Z", "rupeeDifference": 1.5, "duration": "1s", "confidence": "97%", "issues": ["price"]}, {"id": "r2"}]
    (tmp_path / "h.json").write_text(json.dumps(runs, indent=1))
    a, b = files.load_history(spark, str(tmp_path / "h.json")).orderBy("run_id").collect()
    assert (a.vendor, a.discrepancies, a.rupee_difference, a.issues) == ("V", 2, 1.5, ["price"]) and (b.vendor, b.discrepancies) == (None, 0)


def test_failures_by_category_and_reports(spark, tmp_path):
    failures = spark.createDataFrame([(1, "execution_error", ["a"]), (2, "partial_extraction", []), (3, "execution_error", ["b", "c"])], "pair_id long, category string, diagnostic_categories array<string>")
    texts = spark.createDataFrame([(1, "x\n" * 900, None), (2, "inv", "po")], "pair_id long, invoice_text string, po_text string")
    files.write_failures(files.failure_rows(failures, texts).repartition(3), str(tmp_path / "log"))
    rows = {r.pair_id: r for r in spark.read.json(str(tmp_path / "log")).collect()}
    assert {k: r.category for k, r in rows.items()} == {1: "execution_error", 2: "partial_extraction", 3: "execution_error"}
    assert len({r.failure_id for r in rows.values()}) == 3 and len(rows[1].invoice_preview) == 1000 and rows[1].invoice_preview.startswith("x\\nx") and rows[3].po_preview == ""
    found = spark.createDataFrame([(1, "bolt", "price", "price_mismatch", 2.0, None, None, "price mismatch")], "pair_id long, item string, field string, type string, invoice_num double, po_num double, difference double, issue string")
    report = files.report_rows(found, spark.createDataFrame([(1,), (2,)], "pair_id long"))
    files.write_report(report, str(tmp_path / "report"))
    back = {r.pair_id: tuple(r)[1:] for r in spark.read.option("header", True).csv(str(tmp_path / "report")).collect()}
    assert back == {"1": ("bolt", "price", "2.0", "N/A", "N/A", "price mismatch"), "2": ("-", "-", "-", "-", "-", "No discrepancies found")}


def test_written_tables_go_again(spark):
    path = tables.stored(spark.range(5).withColumn("x", F.col("id") * 2), "test")
    assert spark.read.parquet(path).count() == 5
    tables.released(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
