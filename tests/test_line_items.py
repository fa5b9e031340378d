"""The readers of whole documents, on short texts of the kinds that are met: tables, misread tables, blanks for columns, tax columns."""

import pytest

from ledgerline.operators import line_items as L

TABLE = "Sr No | Item        | Qty | Rate    | Amount\n"
TEXTS = {
    "clean": "\nINVOICE\nInvoice No: INV-2024-001\nDate: 15/03/2024\nVendor: ABC Enterprises\n\n" + TABLE + "1     | Laptop      | 10  | 45000   | 450000\n2     | Mouse       | 20  | 500     | 10000\n3     | Monitor     | 5   | 12000   | 60000\n4     | Keyboard    | 15  | 800     | 12000\n\nSubtotal: 532000\nGST @ 18%: 95760\nGrand Total: 627760\n",
    "corrupted": "\nlnv0ice No: lNV-2024-003\nDate: 25/O3/2024\n\nSr No | ltem        | oty | Prlce   | Am0unt\n1     | Lapt0p      | l0  | 45,OOO  | 45O,OOO\n2     | M0use       | 2O  | 5OO     | lO,OOO\n3     | Monltor     | 5   | 12,OOO  | 6O,OOO\n4     | Keyb0ard    | l5  | 8OO     | l2,OOO\n",
    "blurry": "\nINV\nDate: 1 /0 /202\n\nItem Qty Price\nLaptop 10 45000\nMou e 20 0\nM nitor 5 12000\n",
    "gst": "\nTAX INVOICE\nInvoice No: GST/2024/001\nGSTIN: 27AABCU9603R1ZM\nDate: 01/04/2024\n\nSr | Item        | HSN   | Qty | Rate  | Taxable | CGST 9% | SGST 9% | Total\n1  | Office Chair| 94017 | 10  | 5000  | 50000   | 4500    | 4500    | 59000\n2  | Desk        | 94036 | 5   | 12000 | 60000   | 5400    | 5400    | 70800\n\nSubtotal: 134000\nCGST: 12060\nGrand Total: 158120\n",
    "duplicates": "\nINVOICE\nInvoice No: INV-2024-004\n\nItem        | Qty | Rate\nLaptop      | 5   | 45000\nMouse       | 10  | 500\nLaptop      | 5   | 45000\nKeyboard    | 8   | 800\n",
    "labelled": "Items: Steel bolt qty 10 price 450; Item: Copper pipe, Qty: 3, Rate: Rs. 1,200.50",
    "swapped": "Desk lamp qty 400 price 20",
    "empty": "",
    "short": "Invoice No: 001",
    "boxes": "\n[123.45, 678.90] [234.56, 789.01] [345.67, 890.12]\n[456.78, 901.23] [567.89, 012.34]\n",
    "null": None,
}


@pytest.fixture(scope="module")
def read(spark):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")
    return {r.doc_id: r for r in L.to_structured_json(L.structured_documents(docs), keep=True).collect()}


def items(row):
    return [(x["item"], x["qty"], x["price"], x["total"]) for x in row.line_items or []]


def test_clean_table(read):
    row = read["clean"]
    assert items(row) == [("laptop", 10, 45000, 450000), ("mouse", 20, 500, 10000), ("monitor", 5, 12000, 60000), ("keyboard", 15, 800, 12000)]
    assert {x["parse_strategy"] for x in row.line_items} == {"columnar"} and all(x["confidence"] == 0.98 for x in row.line_items)
    assert row.totals == {"subtotal": 532000, "grand_total": 627760} and row.failure_reason is None and row.parse_success
    assert '"item":"laptop"' in row.structured_json and '"grand_total":627760.0' in row.structured_json


def test_misread_table(read):
    # the misread document number counts as a name with two numbers
    assert [(x[0], x[1], x[2]) for x in items(read["corrupted"])] == [("lnv0ice no lnv", 3, 2024), ("lapt0p", 10, 45000), ("m0use", 20, 500), ("monltor", 5, 12000), ("keyb0ard", 15, 800)]


def test_tax_columns(read):
    # the registration number is a name with numbers as well
    assert items(read["gst"])[1:] == [("office chair", 10, 5000, 59000), ("desk", 5, 12000, 70800)]


def test_repeated_rows_are_skipped(read):
    row = read["duplicates"]
    assert [x[:3] for x in items(row)] == [("laptop", 5, 45000), ("mouse", 10, 500), ("keyboard", 8, 800)]
    assert [x["reason"] for x in row.skipped_rows] == ["regex mismatch", "duplicate_row"]
    assert row.score == pytest.approx(0.98 * 0.7 + 0.3 * 3 / 5, abs=1e-4)


def test_labels_and_blanks(read):
    assert [x[:3] for x in items(read["labelled"])] == [("steel bolt", 10, 450), ("copper pipe", 3, 1200.5)]
    assert {x["parse_strategy"] for x in read["labelled"].line_items} == {"labeled"}
    assert ("laptop", 10, 45000) in [x[:3] for x in items(read["blurry"])]


def test_swapped_amounts(read):
    (row,) = read["swapped"].line_items
    assert (row["qty"], row["price"], row["swapped"], row["reconstructed"], row["total"]) == (20, 400, True, True, 8000)


def test_texts_without_items(read):
    assert [(read[k].failure_reason, read[k].candidates, read[k].line_items) for k in ("empty", "null", "boxes")] == [("no rows found", 0, None), ("no rows found", 0, None), ("coordinate_payload_detected", 0, None)]
    assert read["short"].items == 0 and not read["short"].parse_success


def test_document_confidence_is_meant(spark):
    lines = L.split_lines(spark.createDataFrame([("a", TEXTS["clean"], 0.5), ("b", TEXTS["clean"], None)], "doc_id string, text string, confidence double"))
    assert {(r.doc_id, r.parsed.confidence) for r in L.parse_lines(lines).where("parsed is not null").collect()} == {("a", 0.74), ("b", 0.98)}


def test_a_dictionary_of_lines_gives_what_parsing_each_gives(spark, monkeypatch):
    from ledgerline.operators import line_items as L

    monkeypatch.setattr(L, "HOT_ROWS", 3)
    texts = ["Sr No | Item | Qty | Rate | Amount\n1 | steel rod | 2 | 50 | 100\n2 | bolt | 3 | 4 | 12", "Item | Rate | Qty | Amount\n1 | steel rod | 2 | 50 | 100\nbolt qty 3 price 4 tax 18%", "bolt qty 3 price 4 tax 18%\nbolt qty 3 price 4 tax 18%\nwasher 5 1.5 7.5\nTotal Amount: 20.50", "", None, "qty rate amount 5"]
    docs = spark.createDataFrame([(k, texts[k % len(texts)], [0.5, None][k % 2]) for k in range(40)], "doc_id long, text string, confidence double")
    lines = L.split_lines(docs)
    plain = lambda df: sorted(repr((r.doc_id, r.line_no, r.raw, r.cleaned, r.parsed, r.reason)) for r in df.collect())
    assert plain(L.parse_distinct(lines)) == plain(L.parse_lines(lines)) and lines.count() > 60


def test_repairs_change_what_they_did(spark):
    """Texts with and without anything to repair, against the repairs applied one by one."""
    from pyspark.sql import functions as F

    from ledgerline.functions import scalars as S

    texts = ["steel rod", " a  b", "qty10", "PR1CE 5", "a|b", "x\r\ny", "1tem", "12", "12.50", "1,5", "q t y", "\t5", "a..b", "", None, "â‚¹ 5", "rs. 50", "amount5x", "ratex"]
    slow = F.coalesce("t", F.lit(""))
    slow = F.replace(F.replace(slow, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for bad, good in S.MOJIBAKE:
        slow = F.replace(slow, F.lit(bad), F.lit(good))
    for pattern, to in S.OCR_REPAIRS:
        slow = F.regexp_replace(slow, f"(?U){pattern}", to)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.normalize_ocr_text(F.col("t")).alias("a"), S.strip(slow).alias("b"), S.normalize_currency(F.col("t")).alias("c")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and [rows[k].c for k in (7, 8, 9)] == [12.0, 12.5, 15.0]


def test_what_stands_around_a_mark_is_asked_of_amounts_only(spark):
    from pyspark.sql import functions as F

    from ledgerline.operators import line_items as L

    marks = spark.createDataFrame([("blue bolt 5 tax 18%",)], "line string").select(L.line_marks(F.col("line"))["marks"].alias("m")).first().m
    told = [(m.value, m.left is not None, m.is_percent) for m in marks]
    assert [t for t in told if t[0] is None] == [(None, False, None)] * (len(told) - 2) and len(told) > 2
    assert [(t[0], t[1]) for t in told if t[0] is not None] == [(5.0, True), (18.0, True)]
