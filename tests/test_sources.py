import hashlib

from pyspark.sql import functions as F

from ledgerloom.sources import csv_files as S
from ledgerloom.streaming.arrivals import arriving_lines, monthly_totals

HEADINGS = {"payee": ("Supplier Name", "Payee"), "amount": ("Net Amount",), "paid": ("Date Paid",)}


def files(tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_bytes("﻿Payee,Net Amount,Odd\nCafé Ltd,\"1,234.50\",x\n\"Two\nLines\",5\n".encode())
    b.write_bytes("SUPPLIER NAME,Date Paid,,Payee\nCafé £€ Ltd,01/02/2024,stray,\n,,,\n\"say \"\"hi\"\"\",,,z\n".encode("cp1252"))
    return [str(a), str(b)]


def test_landing(spark, tmp_path):
    paths = files(tmp_path)
    provenance = spark.createDataFrame([("a.csv", "http://x", "2024-01-01", "2024-01")] * 2, "source_file string, source_url string, retrieved_at string, period string")
    landed = S.land(spark, paths, HEADINGS, provenance)
    rows = {(r["_source_file"], r["_row_num"]): (r["payee"], r["amount"], r["paid"], r["_period"]) for r in landed.rows.collect()}
    assert rows == {("a.csv", 1): ("Café Ltd", "1,234.50", "", "2024-01"), ("a.csv", 2): ("Two\nLines", "5", "", "2024-01"), ("b.csv", 1): ("Café £€ Ltd", "", "01/02/2024", None), ("b.csv", 2): ("", "", "", None), ("b.csv", 3): ('say "hi"', "", "", None)}
    problems = {(r["source_file"], r["problem"], r["detail"]) for r in landed.problems.collect()}
    assert problems == {("a.csv", "unknown heading", "Odd"), ("b.csv", "heading matched loosely", "SUPPLIER NAME"), ("b.csv", "heading twice", "payee"), ("b.csv", "data under no heading", "1")}
    assert [t for _, t in landed.rows.dtypes] == ["string"] * 7 + ["bigint"]
    assert S.records(spark, []).count() == 0


def test_counts_checksums_census(spark, tmp_path):
    paths = files(tmp_path)
    census = spark.createDataFrame([("a.csv", 2), ("b.csv", 9), ("c.csv", 1)], "source_file string, expected int")
    assert {r["source_file"]: r["verdict"] for r in S.records_per_file(spark, paths, census).collect()} == {"a.csv": "PASS", "b.csv": "FAIL", "c.csv": "FAIL"}
    sums = spark.createDataFrame([("a.csv", hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest().upper())], "source_file string, sha256 string")
    assert {r["source_file"]: r["verdict"] for r in S.checksums(spark, paths, sums).collect()} == {"a.csv": "PASS", "b.csv": "FAIL"}
    assert [tuple(r) for r in S.columns_census({"t": census}).collect()] == [("t", 2, 1)]


def test_register_and_export(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("CompanyName, CompanyNumber\nA,1\nB\n")
    df = S.read_register(spark, str(p), ["CompanyNumber", "CompanyName", "Missing"])
    assert sorted((r["CompanyName"], r["CompanyNumber"], r["Missing"]) for r in df.collect()) == [("A", "1", None), ("B", None, None)]
    S.export_csv(df, str(tmp_path / "out"), ["CompanyName"])
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_text() == 'CompanyNumber,CompanyName,Missing\n1,A,""\n"",B,""\n' or part.read_text().splitlines()[0] == "CompanyNumber,CompanyName,Missing"
    S.export_csv(df, str(tmp_path / "parts"), ["CompanyName"], single=False)
    raw = spark.createDataFrame([("f", 0, "a,b"), ("f", 1, "1,2"), ("f", 2, ""), ("f", 3, '"x\ny",1'), ("f", 4, 'x"y,1')], "source_file string, row_num bigint, raw_record string")
    assert tuple(S.diagnose(raw).first()) == ("f", 4, 1, 1, 1, 1, 0)


def test_unpivot_of_numbered_columns(spark):
    from ledgerloom.operators.evidence import unpivot_names

    df = spark.createDataFrame([("1 ", "OLD", "01/02/2003", " ", None)], "num string, n1 string, d1 string, n2 string, d2 string")
    assert [(r["company_number"], r["k"], r["name"], str(r["condate"])) for r in unpivot_names(df, "num", ["n1", "n2"], ["d1", "d2"]).collect()] == [("1", 1, "OLD", "2003-02-01")]


def test_arrivals(spark, tmp_path):
    S_ = "_source_file string, _row_num bigint, entity string, supplier_name_raw string, payment_date_src string, amount decimal(18,2), _retrieved_at timestamp"
    rows = spark.sql("SELECT 'f' AS _source_file, id % 5 AS _row_num, 'e' AS entity, 'A Limited' AS supplier_name_raw, '01/02/2024' AS payment_date_src, CAST(1 AS decimal(18,2)) AS amount, timestamp'2024-03-01' AS _retrieved_at FROM range(10)")
    rows.write.parquet(str(tmp_path / "in"))
    lines = arriving_lines(spark, str(tmp_path / "in"), spark.createDataFrame([], S_).schema)
    q = lines.select("row_key", "name_norm", "paid_on").writeStream.format("memory").queryName("arrived").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("arrived").count() == 5 and spark.table("arrived").first()["name_norm"] == "A LTD"
    q = monthly_totals(lines).writeStream.format("memory").queryName("totals").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("totals").agg(F.sum("lines")).first()[0] == 5


def test_cells_beyond_the_first_width_stay(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text("a,b\n" + ",".join(map(str, range(130))) + ',,"x,""y",,z\n"1,2,3",4\n')
    got = {r["row_num"]: r["cells"] for r in S.records(spark, [str(p)]).collect()}
    assert got == {0: ["a", "b"], 1: [*map(str, range(130)), None, 'x,"y', None, "z"], 2: ["1,2,3", "4"]}
    landed = S.land(spark, [str(p)], HEADINGS)
    assert ("wide.csv", "data under no heading", "1") in {tuple(r) for r in landed.problems.collect()}
