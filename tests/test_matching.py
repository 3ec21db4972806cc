import random

from pyspark.sql import functions as F

from ledgerloom.operators import row_roles, tiers
from ledgerloom.operators.components import components
from ledgerloom.operators.simjoin import prefix_join
from ledgerloom.operators.skew import checked_join, hot_keys


def test_prefix_filter_loses_nothing(spark):
    random.seed(7)
    sets = lambda n: [(k, sorted({f"t{int(random.paretovariate(0.7)) % 30}" for _ in range(random.randint(0, 7))})) for k in range(n)]
    a, b = sets(120), sets(120)
    da, db = spark.createDataFrame(a, "x int, tokens array<string>"), spark.createDataFrame(b, "y int, tokens array<string>")
    for t in (0.5, 0.6, 0.8, 1.0):
        want = {(i, j) for i, s in a for j, u in b if s and u and len(set(s) & set(u)) >= t * len(set(s) | set(u))}
        assert {(r["x"], r["y"]) for r in prefix_join(da, db, "x", "y", t).collect()} == want


def test_components(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("m", "m"), ("y", None)] + [(f"p{k:02d}", f"p{k + 1:02d}") for k in range(20)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got["c"] == got["a"] == "a" and got["y"] == "x" and {v for k, v in got.items() if k[0] == "p"} == {"p00"} and "m" not in got
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_checked_join_beyond_its_bound(spark):
    left = spark.range(300).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        one = sorted(map(tuple, checked_join(left, small, ["k"], how, bound=100).collect()))
        assert one == sorted(map(tuple, checked_join(left, small, ["k"], how, bound=2, salts=3).collect()))
    assert [(r["k"], r["_parts"]) for r in hot_keys(left.withColumn("k", F.when(F.col("id") < 200, 0).otherwise(F.col("k"))), "k", least=50).collect()] == [(0, 5)]


def test_tiers(spark):
    companies = spark.createDataFrame([
        ("1", "ACME LIMITED", "ACME LTD", "Active", None, "AB1 2CD"), ("2", "ACME PLC", "ACME PLC", "Active", None, "AB1 2CD"), ("3", "BETA LTD", "BETA LTD", "Dissolved", None, None), ("4", "TWIN LTD", "TWIN LTD", "Active", None, "ZZ1 1ZZ"), ("5", "TWIN LTD", "TWIN LTD", "Active", None, "ZZ1 1ZZ"),
        ("OE1", "OVERSEAS LTD", "OVERSEAS LTD", "Active", None, None), ("NF1", "ACME LTD", "ACME LTD", "Active", None, None), ("NF2", "LONE LTD", "LONE LTD", "Active", None, None), ("6", "GREAT WESTERN RAILWAY LTD", "GREAT WESTERN RAILWAY LTD", "Active", None, None),
    ], "company_number string, company_name string, company_name_norm string, company_status string, incorporation_date date, postcode string")
    universe = tiers.company_universe(companies)
    assert {r[0] for r in universe.select("company_number").collect()} == {"1", "2", "3", "4", "5", "6", "NF2"}
    spend = spark.createDataFrame([("ACME LTD", 1, "AB1 2CD"), ("ACME LLP", 2, "ab12cd"), ("BETA LTD", 3, None), ("TWIN LTD", 4, "ZZ1 1ZZ"), ("GREAT WESTERN TRAINS RAILWAY", 5, None), ("WESTERN", 6, None), (None, 7, None)], "supplier_name_norm string, amount int, supplier_postcode_src string").selectExpr("*", "CAST(NULL AS date) AS payment_date", "false AS is_redacted")
    contracts = spark.createDataFrame([("ACME LTD", "1"), ("BETA LTD", "9"), ("TWIN LTD", "4"), ("TWIN LTD", "5"), ("ACME LLP", "1")], "supplier_name_norm string, supplier_company_number string")
    names = tiers.name_universe(spend, contracts)
    verdict = lambda df: {r["supplier_name_norm"]: r["reject_reason"] for r in df.collect()}
    assert verdict(tiers.tier1(names, contracts, universe)) == {"ACME LTD": None, "BETA LTD": "number_not_in_register", "TWIN LTD": "ambiguous", "ACME LLP": "register_name_disagrees"}
    t2, t3 = tiers.tier2(names, universe), tiers.tier3(names, universe)
    assert verdict(t2) == {"ACME LTD": None, "BETA LTD": "single_candidate_not_active", "TWIN LTD": "ambiguous"}
    assert verdict(t3) == {"ACME LTD": "ambiguous", "ACME LLP": "ambiguous", "TWIN LTD": "ambiguous"}
    found = {(r["supplier_name_norm"], r["company_number"], round(r["score"], 3)) for r in tiers.tier4_candidates(names, t2, t3, universe).collect()}
    assert ("GREAT WESTERN TRAINS RAILWAY", "6", 0.75) in found and not any(n == "ACME LLP" for n, *_ in found)


def test_workbook_roles(spark):
    S = "_source_file string, _row_num int, supplier_name_raw string, amount decimal(18,2), is_redacted boolean, expense_type_raw string"
    rows = [("w", 1, "Alpha", 5, False, "a"), ("w", 2, None, 5, False, None), ("w", 3, "REDACTED", 7, True, "b"), ("w", 4, "Beta", 1, False, "b"), ("w", 5, "", 8, False, None), ("w", 6, "", None, False, None), ("w", 7, "Reconciliation to stack:", None, False, None), ("w", 8, "Hold", 5, False, None), ("w", 9, "Publish", 8, False, None),
            ("w", 10, "Publish", 9, False, None), ("w", 11, "Total stack", 13, False, None), ("w", 12, "Gamma", 7, False, "b"), ("w", 13, "", 7, False, None), ("t", 1, "A", 2, False, None), ("t", 2, "B", 3, False, None), ("t", 3, "Total", 5, False, None), ("l", 1, "A", 2, None, None), ("l", 2, None, 2, None, None), ("l", 3, "B", 1, None, None), ("l", 4, "", 1, None, None)]
    from decimal import Decimal

    df = spark.createDataFrame([(f, n, s, None if a is None else Decimal(a), r, e) for f, n, s, a, r, e in rows], S)
    got = {(r["_source_file"], r["_row_num"]): (r["row_role"], r["is_redacted"]) for r in row_roles.classify_rows(df).collect()}
    assert len(got) == len(rows)
    assert [got["w", k][0] for k in range(1, 14)] == ["out_of_scope_section", "section_total", "transaction", "transaction", "section_total", "section_header", *["reconciliation"] * 5, "annex_duplicate", "section_total"]
    assert got["w", 12][1] is True and [got["t", k][0] for k in (1, 2, 3)] == ["transaction", "transaction", "file_total"] and got["l", 4][0] == "trailing_artefact" and got["l", 2][0] == "transaction"


def test_running_count_over_blocks(spark):
    df = spark.range(200).select((F.col("id") % 3).cast("string").alias("f"), "id", (F.col("id") % 7 == 0).alias("hit"))
    got = {(r["f"], r["id"]): r["n"] for r in row_roles.running_count(df, F.col("hit"), "f", "id", "n", block=16).collect()}
    assert got == {(str(k % 3), k): sum(1 for j in range(k) if j % 3 == k % 3 and j % 7 == 0) for k in range(200)}
