"""Whether a document's items come from the parser is told by its response alone."""

from pyspark.sql import functions as F

from ledgerline.operators import responses as P
from ledgerline.plans import text_queries as T

SF = "/root/testdata/sf0.001"


def test_fallbacks_are_those_of_the_chosen_source(spark):
    rows = [(1, '{"items": [{"item": "Bolt", "qty": 2, "price": 5}]}', "x"), (2, '{"items": [7, {"item": "Cog", "qty": -1, "price": 1}]}', "x"), (3, "{broken", "x"), (4, None, "x"), (5, '{"items": [{"item": "Nut", "qty": "3", "price": 0}]}', " "), (6, '{"items": [null, {"item": "oty", "qty": 1, "price": 1}]}', None), (7, '{"items": [null, {"qty": 1}, {"item": " Nut ", "qty": "Rs 3", "price": "1"}]}', "x")]
    parsed = P.parse_response(spark.createDataFrame(rows, "doc_id long, raw_response string, text string"))
    model = P.validate_items(P.raw_entries(parsed))
    none = model.where("false")
    told = {r.doc_id: r.fallback_used for r in P.used_fallback(parsed).collect()}
    assert told == {r.doc_id: r.f for r in P.select_source(model, none, parsed).groupBy("doc_id").agg(F.bool_or("fallback_used").alias("f")).collect()}
    assert told == {1: False, 2: True, 3: True, 4: True, 5: True, 6: True, 7: False}


def test_fallbacks_need_no_rows_of_items(spark):
    made = T.fallbacks(spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    # no join of items with documents, no window over them: each had been a shuffle of all lines
    assert plan.count("Join") <= 1 and "Union" not in plan and plan.count("Window [") <= 1
    assert sorted(map(tuple, made.collect())) == sorted((r.doc_id, r.f) for r in T.select_source(spark, SF).groupBy("doc_id").agg(F.bool_or("fallback_used").alias("f")).collect())
