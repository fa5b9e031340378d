import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: One or more of each family; the other queries with SQL take the same paths.
SOME = """a3_gate_min_text a8_report_rows a9_failure_record a5_flatten_table_rows b2_row_threshold b3_cluster_rows b6_page_confidence b7_choose_pages b8_assemble_docs c3_normalize_currency c8_match_key c10_item_quality
    d8_numeric_tokens d9_assign_roles d13_parse_lines d14_skip_reasons d18_structured_documents e3_validate_items e5_score_extraction e7_deviation f1_group_items f5_greedy_assignment f7_price_check
    f8_missing_items f9_duplicate_items f10_discrepancies f11_pair_summary f12_confidence_flags g3_vendor_stats h2_scenario_accuracy h3_accuracy_summary s2_daily_counts w1_text_to_verdict""".split()


@pytest.mark.parametrize("name", SOME)
def test_rows_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "orders", "lineitem", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    made = entry.queries()[name](spark, SF)
    told = con.execute(entry.oracle_sql()[name])
    names = sorted(made.columns)
    assert names == sorted(d[0] for d in told.description)
    place = {d[0]: k for k, d in enumerate(told.description)}
    plain = lambda v: round(v, 6) if isinstance(v, float) else str(v)[:19]
    assert sorted(repr([plain(r[n]) for n in names]) for r in made.collect()) == sorted(repr([plain(r[place[n]]) for n in names]) for r in told.fetchall())
