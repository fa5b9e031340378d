import pytest
from pyspark.sql import functions as F

from ledgerline.functions import matching, scalars as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, value",
    [("5000", 5000), ("5000.50", 5000.5), ("1,500", 1500), ("1,50,000", 150000), ("Rs. 5000", 5000), ("INR 5000", 5000), ("-500", -500), ("1, 500", 1500), ("10,00,000", 1000000), (None, None), ("", None), ("abc", None), (".", None)],
)
def test_currency(spark, text, value):
    assert one(spark, text, S.normalize_currency) == value


@pytest.mark.parametrize("text, value", [("18%", 18), ("9.5%", 9.5), ("-5%", None), (None, None)])
def test_percentage(spark, text, value):
    assert one(spark, text, S.normalize_percentage) == value


@pytest.mark.parametrize("text, key", [("LAPTOP", "laptop"), ("Chair j", "chair"), ("cpu.", "cpu"), ("lapt0p", "laptop"), ("", ""), (None, "")])
def test_match_key(spark, text, key):
    assert one(spark, text, S.normalize_for_matching) == key


@pytest.mark.parametrize("text, reason", [("Laptop", "ok"), ("j", "garbage_token:'j'"), ("Total.", "garbage_token:'total'"), ("", "empty"), (None, "empty")])
def test_item_quality(spark, text, reason):
    assert one(spark, text, S.item_quality)["reason"] == reason


def test_token_set_ratio():
    assert matching.token_set_ratio("laptop", "laptp") == pytest.approx(100 - 100 / 11)
    assert matching.token_set_ratio("old bolt", "cold bolt") == pytest.approx(100 - 100 / 17)
    assert matching.token_set_ratio("", "x") == 0


def test_well_written_texts_are_left_alone_by_one_look(spark):
    """Tables with spaced bars and lower-case field words need no repair; anything that would change still does."""
    from ledgerline.functions import scalars as S

    spoilt = lambda t: spark.range(1).select(F.lit(t).rlike(S._SPOILT)).first()[0]
    assert not any(spoilt(t) for t in ("1 | bolt | 5 | 2.5", "bolt qty 5 price 2.5", "quantity 3 rate 4"))
    assert all(spoilt(t) for t in ("a|b", "a || b", "| a", "QTY 5", "q t y 5", "Price 5", "qty5", "a  b", "a\tb", "am0unt", "::"))
    assert spark.range(1).select(S.clean_ocr_text(F.lit("bolt QTY5 | 2 Total: 10"))).first()[0] == "bolt qty 5 | 2 \nTotal: 10"
