from datetime import date
from decimal import Decimal

from ledgerloom.operators import staging

RAW = "source_file string, row_num bigint, raw_record string, extra string"
PUBLISHERS, KINDS, CONFIRMED = {"acme": "Acme Council"}, {"Acme Council": "local"}, {}


def raw(spark, records, file="acme_2024.csv"):
    return spark.createDataFrame([(file, k, r, "x") for k, r in enumerate(records)], RAW)


def staged(df):
    return {r["_row_num"]: r for r in staging.stage_spend(df, PUBLISHERS, KINDS, CONFIRMED).collect()}


def test_spend_lines(spark):
    df = raw(spark, ["\ufeffPayee, £ ,Date Paid,Exp Typ", '"Smith, J & Co Limited","1,000.50",01/02/2024,Works', "REDACTED,(20.50),3-Feb-24, ", "too,few", ",,,", 'Zed,12,31/02/2024,x', None, 'Zed,"a"b,01/02/2024,x', "Total,980.00,01/02/2024,"])
    got = staged(df)
    assert set(got) == {1, 2, 8}
    assert (got[1]["supplier_name_norm"], got[1]["amount"], got[1]["payment_date"], got[1]["entity"], got[1]["publisher_type"], got[1]["supplier_postcode_src"]) == ("SMITH J AND CO LTD", Decimal("1000.50"), date(2024, 2, 1), "Acme Council", "local", None)
    assert got[2]["is_redacted"] and got[2]["amount"] == Decimal("-20.50") and got[2]["expense_type_raw"] is None
    assert [got[k]["row_role"] for k in (1, 2, 8)] == ["transaction", "transaction", "file_total"]


def test_unknown_publisher_no_header_empty_table(spark):
    other = staged(raw(spark, ["Supplier,Amount,Date", "A,1,01/02/2024", "A,1,01/02/2024"], "zzz_1.csv"))
    assert other[1]["entity"] is None and other[1]["publisher_type"] is None and other[1]["amount_vat_basis"] == "code" and len(other) == 2
    assert staged(raw(spark, ["Supplier,Amount", "A,1"]).where("row_num > 0")) == {}
    assert staged(raw(spark, ["Supplier,Amount", "A,1"]).limit(0)) == {}


def test_companies(spark):
    df = raw(spark, ["CompanyName, CompanyNumber,CompanyStatus,IncorporationDate", "The Acme & Sons Limited,sc12,Active ,02/03/2001", "No Number,,Active,02/03/2001", "X,12,,02/03/2001"])
    got = {r["company_number"]: r for r in staging.stage_companies(df).collect()}
    assert set(got) == {"SC000012", "00000012"}
    assert (got["SC000012"]["company_name_norm"], got["SC000012"]["company_status"], got["SC000012"]["incorporation_date"], got["00000012"]["company_status"], got["00000012"]["postcode"]) == ("ACME AND SONS LTD", "Active", date(2001, 3, 2), None, None)


def test_contracts(spark):
    df = spark.createDataFrame([("r1", " b ", "A Limited", "GB-COH", " 12", "2024-05-01T10:00:00Z"), ("r1", "", None, "other", "12", "soon"), (None,) * 6], "ocid string, buyer string, supplier_name string, category string, identifier string, release_date string")
    got = [tuple(r) for r in staging.stage_contracts(df).collect()]
    assert got == [("r1", "b", "A Limited", "A LTD", "00000012", None, date(2024, 5, 1), None), ("r1", None, None, None, None, None, None, None), (None,) * 8]


def test_staged_rows_that_come_from_nowhere(spark):
    df = raw(spark, ["Supplier,Amount", "A,1", "B,2"])
    rows = spark.createDataFrame([("acme_2024.csv", 1), ("acme_2024.csv", 9)], "_source_file string, _row_num bigint")
    assert [tuple(r) for r in staging.staged_to_raw(rows, df).collect()] == [("acme_2024.csv", 2, 2, 1, "FAIL")]
    assert [tuple(r) for r in staging.staged_to_raw(rows.limit(1), df).collect()] == [("acme_2024.csv", 2, 1, 1, "PASS")]
