import pytest
from pyspark.sql import functions as F

from ledgerline.functions import matching, names, scalars as S
from ledgerline.operators import line_items as L


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", f(F.col("v")).alias("r")).orderBy("k").collect()
    return [r.r for r in rows]


def test_ocr_text(spark):
    told = {"qty10": "qty 10", "price5000": "price 5000", "10qty": "10 qty", "prlce": "price", "pr1ce 5": "price 5", "1tem": "item", "q t y": "qty", "a|b": "a | b", "a::b--c": "a:b-c", "am0unt": "amount", "qtv 3": "qty 3", "â‚¹500": "rs 500", "x\r\ny\rz": "x\ny\nz", " a \t b ": "a b", "Crate": "Crate"}
    assert each(spark, list(told), S.normalize_ocr_text) == list(told.values())
    assert each(spark, [None, ""], S.normalize_ocr_text) == ["", ""]


def test_parser_cleanup(spark):
    told = {"qty5": "qty 5", "a 1. Bolt 2. Nut": "a \n1. Bolt \n2. Nut", "x 5 total: 9": "x 5 \ntotal: 9", "tax18": "tax 18", "a\n\n\n\nb": "a\n\nb", "Total: 3": "Total: 3"}
    made = each(spark, list(told), S.clean_ocr_text)
    assert [m.lstrip("\n") for m in made] == list(told.values())


def test_numeric_tokens_and_safe_numbers(spark):
    assert each(spark, ["l0", "45,OOO", "bolt", "B8%", "x1", "S", None], S.clean_numeric_token) == ["10", "45,000", "bolt", "88%", "x1", "S", None]
    assert each(spark, ["42", "3.14", "1,500", "Rs. 5000", "abc", None, "", "1-2", "1.2.3", "5."], S.safe_number) == [42, 3.14, 1500, 5000, None, None, None, None, None, 5]
    assert each(spark, ["10", "10.0", "2.5", None, "abc", "6 5000"], S.normalize_quantity) == [10, 10, 2.5, None, None, 65000]


def test_item_names(spark):
    told = {"Laptop": "laptop", "1. Laptop": "laptop", "01 Laptop": "laptop", "Item: Laptop": "laptop", "": "", None: None, "Office Chair": "office chair", "Qty Desk Price": "desk", "PO No 77 Steel bolt": "steel bolt", "(Desk)": "desk", "desk@home": "desk home"}
    assert each(spark, list(told), names.normalize_item_name) == list(told.values())


def test_labels():
    """Words near a label count as one, misread characters are mapped; 'vat' becomes 'yat' and is none."""
    assert matching.labels_among({"qty", "Qty:", "prlce", "1tem", "crate", "gate", "rice", "t0tal", "ite", "bolt", "vat", "", "---", "amount)", "quantlty", "date"}) == {"qty", "Qty:", "prlce", "1tem", "crate", "gate", "rice", "t0tal", "ite", "amount)", "quantlty", "date"}
    assert matching.labels_among({"item", "qty"}, ["item"]) == {"item"}


def test_label_tokens_of_a_table(spark):
    tokens = spark.createDataFrame([("qty",), ("bolt",), ("qty",), (None,)], "token string")
    assert sorted((str(r.token), r.is_label) for r in matching.label_tokens(tokens).collect()) == [("None", False), ("bolt", False), ("qty", True)]


def lines(spark, text):
    rows = spark.createDataFrame([(1, text)], "doc_id int, text string").select(L.merge_lines(L.candidate_texts(F.col("text"))).alias("l")).first().l
    return [x.strip() for x in rows]


def test_split_and_merge(spark):
    assert lines(spark, "head\nItems: bolt 2 5; nut 3 6\n\nwasher\n4 7") == ["bolt 2 5", "nut 3 6", "washer 4 7"]
    assert lines(spark, "Desk\nqty 3\nprice 5\nTotal: 15\nChair 1 2") == ["Desk qty 3 price 5", "Total: 15", "Chair 1 2"]
    assert lines(spark, "Vendor X\nLamp qty 2\nBolt 1 2\nNut 3 4") == ["Vendor X", "Lamp qty 2", "Bolt 1 2", "Nut 3 4"]
    assert lines(spark, "a; ; ;") == ["a; ; ;"]


@pytest.mark.parametrize("line, told", [("Bolt 2 5", True), ("Total 9 9", False), ("Vendor: X 1 2", False), ("Vendor qty 3", True), ("a | 1", True), ("a | b", False), ("Bolt 2", False), ("rate 7", True), ("", False)])
def test_candidate_lines(spark, line, told):
    assert each(spark, [line], L.is_candidate) == [told]


def test_header_map(spark):
    one = lambda t: each(spark, [t], L.header_map)[0]
    h = one("x\nSr | Item | HSN | Qty | Rate | Taxable Amount | GST | Total | Price Total\n1 | a")
    assert (h.item, h.hsn, h.qty, h.price, h.taxable, h.gst, h.total) == (1, 2, 3, 4, None, 6, 7)
    assert one("no table") is None and one("a | b\nItem | Item | Qty").item == 1
