from ledgerline.operators import responses as P
from ledgerline.plans import QUERIES


def test_a_response_is_read_once(spark):
    """The plan's calls of the JSON readers do not grow with the filters behind them (they did: 58 calls, 400 regular expressions)."""
    for name, most in (("e2_parse_response", 8), ("e3_validate_items", 12), ("e5_score_extraction", 12)):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert 0 < plan.count("get_json_object") <= most and plan.count("parseJson") <= 3, name


def test_shapes_of_responses(spark):
    rows = {
        1: '```json\n{"vendor": "V", "items": [{"item": " Bolt ", "qty": 2, "price": "Rs. 5"}, 7, {"item": "Bolt", "qty": 2, "price": 5}]}\n```',
        2: 'so: {"items": "none", "date": null} there',
        3: 'list [{"item": "Nut", "qty": "3", "price": 0}, {"item": "Cog", "qty": -1, "price": 1}] end',
        4: "{broken",
        5: "[1, 2]",
        6: None,
        7: '{"items": []}',
    }
    parsed = P.parse_response(spark.createDataFrame(list(rows.items()), "doc_id long, raw_response string"))
    made = {r.doc_id: (r.vendor, r.raw_items and len(r.raw_items), r.metadata_ok, r.error is None) for r in parsed.collect()}
    # 5 is valid JSON and no object; the braces of 3 are looked at before its brackets
    assert made == {1: ("V", 3, True, True), 2: ("", None, False, True), 3: ("", None, True, True), 4: ("", None, True, False), 5: ("", None, True, False), 6: ("", None, True, False), 7: ("", [], True, True)}
    valid = sorted((r.doc_id, r.pos, r.item, r.qty, r.price) for r in P.validate_items(P.raw_entries(parsed)).collect())
    assert valid == [(1, 0, "Bolt", 2.0, 5.0)]
