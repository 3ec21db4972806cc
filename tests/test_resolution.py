from datetime import date

from ledgerloom.operators import evidence, golden, measuring, quality, reporting

D = date
SPEND = "spend_id string, supplier_name_raw string, supplier_name_norm string, amount decimal(18,2), payment_date date, is_redacted boolean, entity string, publisher_type string, _source_file string, transaction_number string, expense_type_raw string"
T1 = "supplier_name_norm string, candidate_count bigint, candidate_company_number string, reject_reason string, accepted boolean"
T4 = "supplier_name_norm string, in_spend boolean, in_e3 boolean, candidate_company_number string, candidate_company_name string, match_score double, candidate_count bigint"
FIRMS = "company_number string, company_name string, company_status string, incorporation_date date, postcode string"


def frames(spark):
    from decimal import Decimal

    names = ["BY NUMBER", "BY NAME", "BY CODE", "T1 YES", "T4 YES", "T4 OPEN", "STALE", "NO", "LOW", "NONE", "REDACTED", "AMBI"]
    rows = [(f"s{k}", n.title(), n, Decimal(k), D(2024, 1, 1 + k), n == "REDACTED", "e1" if k % 2 else "e2", "local", f"f{k % 3}", "t", "Works" if k % 4 else None) for k, n in enumerate(names)]
    rows += [("x1", "by number", "BY NUMBER", Decimal(5), None, False, "e1", "local", "f0", None, " "), ("x2", None, None, Decimal(7), D(2024, 2, 1), False, "e1", "local", "f0", None, None)]
    spend = spark.createDataFrame(rows, SPEND)
    t = lambda rows: spark.createDataFrame(rows, T1)
    t1 = t([("BY NUMBER", 1, "1", None, True), ("T1 YES", 1, "4", "register_name_disagrees", False), ("AMBI", 2, None, "ambiguous", False)])
    t2, t3 = t([("BY NAME", 1, "2", None, True), ("BY NUMBER", 1, "99", None, True)]), t([("BY CODE", 1, "3", None, True)])
    t4 = spark.createDataFrame([(n, True, False, num, f"FIRM {num}", s, 1) for n, num, s in (("T4 YES", "5", 0.9), ("T4 OPEN", "6", 0.85), ("STALE", "7", 0.95), ("NO", "8", 1.0), ("LOW", "9", 0.6), ("REDACTED", "5", 1.0))], T4)
    own = spark.createDataFrame([(n, num, d, D(2025, 1, 1), note, "user") for n, num, d, note in (("T4 YES", "5", "accepted", "x"), ("STALE", "777", "accepted", "x"), ("GONE", "1", "accepted", "ACCEPT-PAYER-AWARDS (the awards)"))], "supplier_name_norm string, candidate_company_number string, decision string, decided_on date, decision_note string, decided_by string")
    delegated = spark.createDataFrame([("T1 YES", "4", "accepted", D(2025, 1, 2), "C", "n", "builder"), ("T4 YES", "5", "rejected", D(2025, 1, 2), "C", "n", "builder"), ("NO", "8", "rejected", D(2025, 1, 2), "C", "n", "builder"), ("T4 OPEN", "6", "left_open", D(2025, 1, 2), "C", "n", "builder")], golden.DECISION_SCHEMA)
    firms = spark.createDataFrame([(str(k), f"FIRM {k}", "Active", D(2000, 1, 1), None) for k in range(1, 10)] + [("1", "FIRM 1", "Active", D(2000, 1, 1), None)], FIRMS)
    return spend, t1, t2, t3, t4, evidence.decisions_in_force(own, delegated), firms


def test_verdicts_records_and_facts(spark):
    spend, t1, t2, t3, t4, decisions, firms = frames(spark)
    assert {(r["supplier_name_norm"], r["evidence_class"], r["decided_by"]) for r in decisions.collect()} == {("T4 YES", "user_review", "user"), ("STALE", "user_review", "user"), ("GONE", "ACCEPT-PAYER-AWARDS", "user"), ("T1 YES", "C", "builder"), ("NO", "C", "builder"), ("T4 OPEN", "C", "builder")}
    m = golden.assemble_matches(spend, t1, t2, t3, t4, decisions).persist()
    got = {r["supplier_name_norm"]: (r["match_tier"], r["match_confidence"], r["is_resolved"], r["unresolved_reason"], r["has_stale_decision"]) for r in m.collect()}
    assert got == {
        "BY NUMBER": (1, "high", True, None, False), "BY NAME": (2, "high", True, None, False), "BY CODE": (3, "medium", True, None, False), "T1 YES": (1, "reviewed", True, None, False), "T4 YES": (4, "reviewed", True, None, False), "T4 OPEN": (4, "review", False, "review", False),
        "STALE": (4, "review", False, "review", True), "NO": (4, "review", False, "review", False), "LOW": (5, "none", False, "below_threshold", False), "NONE": (5, "none", False, "no_match", False), "REDACTED": (5, "none", False, "redacted", False), "AMBI": (5, "none", False, "ambiguous", False)}
    notes = {r["supplier_name_norm"]: r["resolution_notes"] for r in m.collect()}
    assert "no longer offered" in notes["STALE"] and notes["NONE"] == "tier 4: no similar name" and "0.6000" in notes["LOW"] and notes["AMBI"].startswith("tier 1: more than one company fits")
    g = golden.golden_record(spend, m, firms)
    assert g.count() == 12 and {r["name_variant_count"] for r in g.where("company_number = '1'").collect()} == {2}
    resolved = golden.resolve_spend(spend, m)
    suppliers = reporting.dim_supplier(g, m)
    basis = {r["supplier_name"]: r["resolution_basis"] for r in suppliers.collect()}
    assert basis["FIRM 5"] == "user_review" and basis["FIRM 4"] == "delegated_review" and basis["FIRM 1"] == "method" and basis["Low"] == "unresolved"
    done, open_ = reporting.facts(resolved, suppliers, m)
    checks = quality.run([quality.conserved(spend, resolved), quality.conserved(resolved.where("supplier_key IS NOT NULL"), done.select("amount").unionByName(open_.select("amount"))), quality.unique(g, ["supplier_key"]), quality.foreign_key(resolved, g, "supplier_key"), quality.row_count(spend, 13), quality.schema(spend, ["amount", "lost"]),
                          quality.not_null(spend, ["supplier_name_raw"]), quality.in_set(m, "match_method", ["fuzzy"]), quality.gapless(spend.where("payment_date < '2024-01-05'"), "payment_date"), quality.recompute(done, done.limit(0)), quality.no_fan_out(spend, m, "supplier_name_norm"), quality.reconciled(spend.limit(0), spend, "spend_id", "amount")])
    assert [r["verdict"] for r in checks.collect()] == ["PASS"] * 4 + ["FAIL"] * 4 + ["PASS", "FAIL", "PASS", "FAIL"]
    categories = reporting.dim_category(resolved)
    assert done.unionByName(open_.withColumnRenamed("unresolved_reason", "resolution_basis")).join(categories, "category_key").count() == 13
    exported = reporting.export_fact(done, reporting.export_supplier(suppliers), reporting.numbered(reporting.dim_entity(resolved), "entity", "entity_id"), reporting.numbered(categories, "category_key", "category_id"), reporting.numbered(resolved.select("_source_file").distinct(), "_source_file", "source_file_id"))
    assert exported.count() == done.count()
    assert [r["supplier_id"] for r in reporting.export_supplier(suppliers).orderBy("supplier_key").collect()] == list(range(1, 13))


def test_queue_and_evidence(spark):
    spend, t1, t2, t3, t4, decisions, firms = frames(spark)
    m = golden.assemble_matches(spend, t1, t2, t3, t4, decisions)
    names = spark.createDataFrame([("6", 1, "T4 Open Ltd", D(2024, 5, 1), None), ("6", 1, "T4 Open Ltd", D(2024, 5, 1), None), ("6", 2, "Older", D(2023, 12, 1), None), ("7", 1, "Stale", D(2024, 1, 2), None), ("8", 10, "No", D(2025, 1, 1), None), ("9", 1, None, None, None)], "company_number string, k int, name string, condate date, recorded_on date")
    windows = evidence.previous_name_windows(names, firms.dropDuplicates(["company_number"]))
    assert {(r["company_number"], r["k"]): r["valid_from"] for r in windows.collect()} == {("6", 1): D(2023, 12, 1), ("6", 2): D(2000, 1, 1), ("7", 1): D(2000, 1, 1), ("8", 10): None}
    prev = evidence.previous_name_evidence(spend, t4, t1, windows)
    assert [(r["supplier_name_norm"], r["prev_name"], r["candidate_route"]) for r in prev.collect()] == [("T4 OPEN", "T4 Open Ltd", "tier 4")]
    contracts = spark.createDataFrame([("T4 OPEN LTD", "6", "b2", D(2024, 1, 1)), ("T4 OPEN", "6", "b1", D(2024, 2, 1)), ("NO", "8", "b1", None), ("NO LTD", "1", "b1", None), ("NO", None, "b", None)], "supplier_name_norm string, supplier_company_number string, buyer_name string, award_date date")
    awards = evidence.other_buyer_evidence(t4, contracts)
    assert {(r["supplier_name_norm"], r["awards_for"], r["awards_other"], r["buyers_for"], r["qualifies"]) for r in awards.collect()} == {("T4 OPEN", 2, 0, "b1; b2", True), ("NO", 1, 1, "b1", False)}
    queue = {r["supplier_name_norm"]: r for r in golden.review_queue(spend, m, t1, firms, decisions, prev, awards).collect()}
    assert set(queue) == {"T1 YES", "T4 YES", "T4 OPEN", "STALE", "NO"}
    assert queue["T4 OPEN"]["previous_name_evidence"].startswith("T4 Open Ltd valid 2023-12-01") and queue["T4 OPEN"]["other_buyer_award_evidence"] == "2 for, none other" and queue["T1 YES"]["queue_reason"] == "stated number, other name" and queue["NO"]["decision"] == "rejected"


def test_measures(spark):
    contracts = spark.createDataFrame([("A", "1"), ("A", "1"), ("B", "2"), ("C", "3"), ("D", None)], "supplier_name_norm string, supplier_company_number string")
    t2 = spark.createDataFrame([("A", "1", True), ("C", "9", False)], "supplier_name_norm string, candidate_company_number string, accepted boolean")
    t4 = spark.createDataFrame([("B", "7", 0.9)], "supplier_name_norm string, candidate_company_number string, match_score double")
    curve = {r["threshold"]: (r["matches_made"], r["correct"], r["precision_pct"], r["coverage_pct"], r["recall_pct"]) for r in measuring.precision_curve(contracts, t2, t4).collect()}
    assert curve[0.9] == (3, 2, 66.67, 75.0, 50.0) and curve[0.95] == (2, 2, 100.0, 50.0, 50.0)
    assert {r["tier"]: (r["awards"], r["wrong"]) for r in measuring.precision_per_tier(contracts, t2, t4).collect()} == {"2 exact name": (2, 0), "4 similar name": (1, 1), "5 no match": (1, 0), "ALL TIERS": (4, 1)}
