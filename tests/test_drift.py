from ledgerloom.operators.drift import FIELD_HEADINGS, drift_report, path_types, unified_table, unify

HEADERS = "source_file string, entity string, unit_code string, period string, col_pos int, header_text string"
ROWS = "_source_file string, expense_type_src string, supplier_postcode_src string, source_file string"


def headers(spark, files):
    rows = [(f, "e", u, p, k, h) for f, u, p, hs in files for k, h in enumerate(hs, 1)]
    return spark.createDataFrame(rows, HEADERS)


def test_each_change(spark):
    h = headers(spark, [
        ("a1", "u", "2024-01", ["Expense Type", "Amount"]), ("a2", "u", "2024-03", ["Amount", "﻿ expense  TYPE "]), ("a3", "u", "2024-04", ["ExpTyp", "Postal Code"]), ("a4", "u", "2024-05", ["Amount", "SuppPC"]),
        ("b1", "v", "2024-01", ["ExpTyp"]), ("n1", None, "2024-01", ["ExpTyp"]), ("n2", None, "2024-02", ["Amount"]),
    ])
    rows = spark.createDataFrame([("a1", "Works", None, "x"), ("a1", "Works", None, "x"), ("a2", "4100", "", "x"), ("a2", "4101", None, "x"), ("a3", "4100", "AB1 2CD", "x"), ("a3", None, "12", "x"), ("a3", " ", None, "x"), ("a4", None, "10001", "x"), ("a4", None, "10002", "x")], ROWS)
    got = {(r["source_file"], r["field"][:7], r["change"]) for r in drift_report(h, rows).collect()}
    assert got == {("a2", "expense", "retyped"), ("a3", "expense", "renamed"), ("a3", "supplie", "added"), ("a4", "expense", "removed"), ("a4", "supplie", "renamed"), ("a4", "supplie", "retyped")}


def test_unlisted_headings_are_learnt(spark):
    """With no heading listed but the fields' own names, the report is that of the full list."""
    folder = "/root/testdata/sf0.1"
    heads, rows = spark.read.parquet(f"{folder}/raw_spend_headers.parquet"), spark.read.parquet(f"{folder}/staging_spend.parquet").select("_source_file", *FIELD_HEADINGS)
    report = lambda listed: {(r["source_file"], r["field"], r["change"]) for r in drift_report(heads, rows, headings=listed).collect()}
    whole = report(FIELD_HEADINGS)
    assert report({"expense_type_src": ["expensetype"], "supplier_postcode_src": ["supplierpostcode"]}) == whole and len(whole) > 200


def test_a_new_name_is_no_loss(spark):
    h = headers(spark, [("a1", "u", "2024-01", ["ExpTyp", "Amount"]), ("a2", "u", "2024-02", ["Ledger heading", "Amount"]), ("a3", "u", "2024-03", ["Amount"])])
    rows = spark.createDataFrame([("a1", "Works", None, "x"), ("a2", "Works", None, "x"), ("a3", None, None, "x")], ROWS)
    got = {(r["source_file"], r["change"], r["after"]) for r in drift_report(h, rows).collect()}
    assert got == {("a2", "renamed", "Ledger heading"), ("a3", "removed", None)}


def test_unified_table_and_failed_casts(spark):
    rows = spark.createDataFrame([("a", "4100", None, "x"), ("a", "Works", "", "x"), (None, "x", "y", "x")], ROWS)
    table, report = unify(rows, {"expense_type_src": "bigint"}, "_source_file")
    assert sorted(r["expense_type_src_typed"] or 0 for r in table.collect()) == [0, 0, 4100]
    assert {(r["file"], r["failed"], r["example"]) for r in report.collect()} == {("a", 1, "Works"), (None, 1, "x")}
    whole = unified_table(headers(spark, [("a", "u", "2024-01", ["ExpTyp"])]), rows)
    assert whole.count() == 3
    assert path_types(rows.limit(0), "_source_file", ["expense_type_src"]).count() == 0
    assert drift_report(headers(spark, [("a", "u", "2024-01", ["ExpTyp"])]), rows.limit(0)).count() == 0
