import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C


def values(spark, build, inputs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, v string")
    return [r[1] for r in df.select("k", build(F.col("v"))).orderBy("k").collect()]


@pytest.mark.parametrize("build,cases", [
    (C.normalise_name, {"The Café & Bar Limited": "CAFE AND BAR LTD", "ACME LTD T/A Widgets": "ACME LTD", "A-B - C PLC": "A-B C PLC", "Limited": "LIMITED", "-": None, "": None, None: None, "x Public Limited Company": "X PLC", "Ł b": "B", "XEROX (UK) LIMITED": "XEROX UK LTD", "a" * 5000: "A" * 5000}),
    (lambda v: C.name_core(C.normalise_name(v)), {"ACME PLC": "ACME", "ACME LIMITED": "ACME", "LTD": "LTD"}),
    (C.canon_company_number, {"7140006": "07140006", "0C303675": None, "IP19059R": "IP19059R", "SP2155RS": "SP2155RS", "IP123CUS": "IP123CUS", "SP12BENS": "SP12BENS", "SPARKLES": None, "R1234567": None, "000": None, "SC12345": "SC012345", "123456789": None, ' "12" ': "00000012", None: None, "": None}),
    (lambda v: C.parse_date(v).cast("string"), {"01/03/2024": "2024-03-01", "01/03/24": "2024-03-01", "01-Mar-24": "2024-03-01", "01/03/2024 00:00": "2024-03-01", "1/3/2024 10:11:12": "2024-03-01", "2024-03-01": "2024-03-01", "01-mar-2024": "2024-03-01", "45659": "2025-01-02", "not a date": None, "31/02/2024": None, "": None, None: None}),
    (lambda v: C.parse_amount(v).cast("decimal(20,2)"), {"  £465,000,000.00 ": decimal.Decimal("465000000.00"), "-1,258.14": decimal.Decimal("-1258.14"), "(1,234.50)": decimal.Decimal("-1234.50"), "": None, "-": None, "1.2.3": None, "12-": None, "n/a": None, None: None}),
    (C.is_redacted, {"Redacted Personal Information": True, "REDACTED - PERSONAL DATA": True, "Name redacted": True, "PRIVATE": True, "Redactive Publishing Ltd": False, "Taylor Private Hire": False, "P Bixby T/A Constructive Individuals Ltd": False, None: False}),
    (C.clean_postcode, {" sw1a 1aa": "SW1A1AA", "m1 1ae": "M11AE", "M1": None, "": None, None: None}),
    (lambda v: C.mask_individual(v, F.lit(False)), {"Dr Who": C.WITHHELD_LABEL, "a@b": C.WITHHELD_LABEL, "Drake Ltd": "Drake Ltd", None: None}),
])
def test_vectors(spark, build, cases):
    assert dict(zip(cases, values(spark, build, list(cases)), strict=True)) == cases


def test_accent_table_is_the_rule():
    marked, plain = C.accent_table()
    assert len(marked) == len(plain) and "É" in marked and "Ł" not in marked


def test_keys_and_filled_fields(spark):
    row = spark.range(1).select(C.surrogate_key(F.lit("a"), F.lit(1)).alias("a"), C.surrogate_key(F.lit("a"), F.lit(None)).alias("b"), C.non_blank_fields(F.lit(" "), F.lit(None).cast("string"), F.lit("x")).alias("n")).first()
    assert len(row["a"]) == 64 and row["b"] is None and row["n"] == 1
    assert datetime.date(2024, 1, 1)
