"""Plain texts and rows are told in one look; what they give is what the repairs and the readers give."""

from pyspark.sql import functions as F

from ledgerline.functions import scalars as S
from ledgerline.operators import line_items as L

HEAD = "Sr No | Item | Qty | Rate | Amount\n"
PLAIN = [HEAD + "4 | steel rod | 2.0 | 50.5 | 101.0", "oil gizmo qty 34.0 price 5", "blue bolt 3 4.125 12.38", "lamp qty 400 price 20"]
#: Each has something that only the readers can tell: a misread label, a field or summary word, a large first amount, a mark, another heading.
ODD = ["crate 3 4 12", "ratio 3 4 12", "freight 3 4 12", "elevator qty 3 price 4", "bolt 2000 4 8000", "bolt 3 4", "po 77 bolt 3 4 12", "rs 3 4 12", "Bolt 3 4 12", "bolt 3 4% 12", "Item | Rate | Qty | Amount\nbolt | 3 | 4 | 12", HEAD + "bolt 3 4 12"]


def told(df):
    return sorted(repr((r.doc_id, r.line_no, r.raw, r.cleaned, r.parsed, r.reason)) for r in df.collect())


def test_readers_look_at_odd_rows_only_and_plain_ones_give_the_same(spark, monkeypatch):
    lines = L.split_lines(spark.createDataFrame(list(enumerate(PLAIN + ODD)), "doc_id long, text string"))
    expected, seen, parse = told(L.parse_lines(lines)), [], L.parse_lines
    monkeypatch.setattr(L, "parse_lines", lambda df: seen.append(df) or parse(df))
    assert told(L.parse_distinct(lines)) == expected
    left = {r.cleaned for r in seen[0].select("cleaned").collect()}
    assert "crate 3 4 12" in left and "bolt 2000 4 8000" in left
    assert not left & {"4 | steel rod | 2.0 | 50.5 | 101.0", "oil gizmo qty 34.0 price 5", "blue bolt 3 4.125 12.38", "lamp qty 400 price 20"}


def test_headings_of_like_places_are_kept_apart(spark):
    """A column of the same number under another field is another heading."""
    docs = spark.createDataFrame([(1, "Item | x\nbolt | 3 | 4"), (2, "Qty | x\nbolt | 3 | 4"), (3, "Rate | x\nbolt | 3 | 4")], "doc_id long, text string")
    lines = L.split_lines(docs)
    assert told(L.parse_distinct(lines)) == told(L.parse_lines(lines)) and lines.count() == L.parse_distinct(lines).count()


def test_plain_texts_are_left_and_others_are_not_called_plain(spark):
    plain = ["steel rod 2 3.5", "a | b | 3", "x\nTotal Amount: 5.00", "one, two. three"]
    odd = ["q ty 5", "Pri ce 5", "rat e", "prlce 5", "qtv 3", "x total: 5", "a|b", "a  b", " a", "a\n", "a\n\n\nb", "1. bolt", "a:: b", "qty5", "1tem", "é", "", None]
    rows = spark.createDataFrame([(t,) for t in plain + odd], "t string").select("t", S.is_plain(F.col("t")).alias("p"), S.clean_ocr_text(F.col("t")).alias("c")).collect()
    assert [bool(r.p) for r in rows] == [True] * len(plain) + [False] * len(odd)
    assert all(r.c == r.t for r in rows if r.p)
    cased = spark.createDataFrame([("Qty 5 RATE 3 Crate",)], "t string").select(S.clean_ocr_text(F.col("t")).alias("c")).first().c
    assert cased == "qty 5 rate 3 Crate"
