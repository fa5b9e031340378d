from ledgerline.operators import reconcile as R

ITEMS = "pair_id long, line_no int, item string, qty double, price double"


def found(spark, inv, po):
    sides = [R.group_items(spark.createDataFrame([(1, i, *x) for i, x in enumerate(rows)], ITEMS)) for rows in (inv, po)]
    return {(r.type, r.item) for r in R.discrepancies(*sides).collect()}


def test_equal_sides_agree(spark):
    assert found(spark, [("laptop", 10.0, 45000.0)], [("laptop", 10.0, 45000.0)]) == set()


def test_quantity_and_price(spark):
    assert found(spark, [("laptop", 12.0, 45000.0)], [("laptop", 10.0, 45000.0)]) == {("quantity_mismatch", "laptop")}
    assert found(spark, [("laptop", 10.0, 46000.0)], [("laptop", 10.0, 45000.0)]) == {("price_mismatch", "laptop")}


def test_missing_duplicate_and_fuzzy(spark):
    assert found(spark, [("lapt0p", 1.0, 5.0)], [("laptop", 1.0, 5.0), ("tablet", 1.0, 9.0)]) == {("missing_in_invoice", "tablet")}
    assert found(spark, [("laptop", 5.0, 5.0), ("laptop", 5.0, 5.0)], [("laptop", 10.0, 5.0)]) == {("duplicate_item", "laptop")}


def test_empty_names_and_tables(spark):
    assert found(spark, [("", 1.0, 1.0)], []) == set()


def test_the_rest_of_a_pair_is_matched_once(spark):
    """The names are likened once in the plan, whatever is told of them; issues come with the summary."""
    from ledgerline.operators import analytics as A

    item = "pair_id long, line_no int, item string, qty double, price double"
    inv = spark.createDataFrame([(1, 1, "bolt", 2.0, 5.0), (1, 2, "lapt0p", 30.0, 6.0), (1, 3, "cog", 1.0, 1.0), (1, 4, "cog", 1.0, 1.0)], item)
    po = spark.createDataFrame([(1, 1, "bolt", 20.0, 5.0), (1, 2, "laptop", 3.0, 6.0), (1, 3, "nut", 1.0, 1.0), (2, 1, "nut", 1.0, 1.0)], item)
    found = R.discrepancies_of(R.align_items(inv, po))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("EvalPython") == 1
    told = sorted((r.pair_id, r.section, r.item, r.field, r.entry_count) for r in found.collect())
    assert told == [
        (1, "1_dup_invoice", "cog", "item", 2), (1, "3_exact", "bolt", "quantity", None), (1, "4_fuzzy", "lapt0p", "quantity", None),
        (1, "5_po_only", "nut", "item", 1), (1, "6_invoice_only", "cog", "item", 2), (2, "5_po_only", "nut", "item", 1),
    ]
    pairs = spark.createDataFrame([(1, "V.pdf", None), (2, None, None), (3, None, None)], "pair_id long, vendor string, ts timestamp")
    runs = {r.run_id: r.issues for r in A.to_runs(R.summarize_pairs(pairs, found, issues=True)).collect()}
    assert runs == {"1": ["item", "item", "item", "quantity", "quantity"], "2": ["item"], "3": []}
