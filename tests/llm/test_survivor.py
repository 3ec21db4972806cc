import datetime
import random

from ledgerloom.llm import survivor as S

SCHEMA = "supplier_key string, supplier_name_raw string, rows_n bigint, last_payment date, postcode string, entity string, company_number string, v string"
D = datetime.date


def test_rule_by_brute_force(spark):
    random.seed(6)
    names = ["Acme Ltd", "ACME LTD", "Zed", "TBC", "n.a.", "...", "0000", "xxxx", "", None, "Name withheld", "Ångström"]
    codes = ["ab1 2cd", " AB12CD", "B9A 1AA", "00000", "", None, "ZB4", "c1 1cc"]
    rows = [(f"k{random.randint(0, 25)}", random.choice(names), random.choice((None, 1, 2, 8)), random.choice((None, D(2024, 1, 1), D(2024, 2, 1))), random.choice(codes), "e", None, "clash") for _ in range(150)] + [(None, "A", 1, None, None, "e", None, "x")] * 2 + [("dup", "A", 1, None, None, "e", None, "x")] * 2
    somebody = {"Acme Ltd", "ACME LTD", "Zed", "Ångström"}
    tidy = {"ab1 2cd": "AB1 2CD", " AB12CD": "AB1 2CD", "B9A 1AA": "B9A 1AA", "c1 1cc": "C1 1CC"}
    want = {}
    for key in {r[0] for r in rows if r[0]}:
        own = {r[:7] for r in rows if r[0] == key}
        if len(own) < 2:
            continue
        votes = {}
        for _, n, w, d, *_ in own:
            if n in somebody:
                v = votes.setdefault(n, [0, D(1, 1, 1)])
                v[0] += w or 0
                v[1] = max(v[1], d or D(1, 1, 1))
        name = min(votes, key=lambda n: (-votes[n][0], -votes[n][1].toordinal(), n)) if votes else None
        full = [(-(d or D(1, 1, 1)).toordinal(), -(w or 0), tidy[p]) for _, _, w, d, p, *_ in own if p in tidy]
        want[key] = (name, min(full)[2] if full else "")
    got = {r["supplier_key"]: (r["supplier_name_raw"], r["postcode"]) for r in S.best_records(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want
    assert S.best_records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rule_in_parts(spark, monkeypatch):
    """A group dealt over parts has the survivor of the whole."""
    random.seed(8)
    rows = [("hot", f"Acme {random.choice('abcdefgh')}{k % 90} Ltd", random.choice((None, 1, 2, 8)), random.choice((None, D(2024, 1, 1), D(2024, 2, k % 28 + 1))), f"AB{k % 50} 1CD", "e", None, "x") for k in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = S.best_records(df).collect()
    monkeypatch.setattr(S, "BLOCK", 7)
    assert S.best_records(df).collect() == whole and len(whole) == 1


def test_consensus(spark, monkeypatch):
    spell = ["ACME BUILDING SUPPLIES LTD", "ACME BUILDNG SUPPLIES LTD", "ACME BUILDING SUPLIES LIMITED", "ACME SUPPLIES LTD"]
    assert S.consensus([(s.split(), 1.0) for s in spell]) == "ACME BUILDING SUPPLIES LTD".split()
    rows = [("k", s.title(), 1, None, None, "e", None, "x") for s in spell] + [("k", "TBC", 99, None, None, "e", None, "x"), ("n", None, 1, None, None, "e", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in S.consensus_names(df).collect()] == [("k", "ACME BUILDING SUPPLIES LTD", "Acme Building Supplies Ltd")]
    monkeypatch.setattr(S, "BLOCK", 2)
    assert [tuple(r) for r in S.consensus_names(df).collect()] == [("k", "ACME BUILDING SUPPLIES LTD", "Acme Building Supplies Ltd")]
    assert S.consensus_names(df.limit(0)).count() == 0


def test_profiles_keep_all_votes():
    """However the spellings are parted, no weight is lost, and clear majorities win."""
    random.seed(1)
    spell = [(["ACME", "WEST", "TAXIS"][: random.choice((2, 3, 3))] + random.choice(([], ["LTD"])), float(random.randint(1, 9))) for _ in range(40)]
    whole = S.profile(spell)
    parts = S.aligned(S.profile(spell[:13]), S.profile(spell[13:]))
    for columns in (whole, parts):
        assert all(abs(sum(c.values()) - sum(w for _, w in spell)) < 1e-9 for c in columns)
        assert S.winners(columns)[:3] == ["ACME", "WEST", "TAXIS"]


def test_ranks_decide_token_by_token():
    entries = [(-9, 0, "Acme Taxis", "ACME TAXIS"), (-8, 0, "Acme West Taxis", "ACME WEST TAXIS"), (-8, 0, "Acme West Taxi", "ACME WEST TAXI")]
    assert S.closest_to_consensus(entries) == entries[0]
    assert S.closest_to_consensus([(-1, 0, f"N{k} Ltd", f"N{k} LTD") for k in range(300)])[2] == "N0 Ltd"


def test_order_alone_decides_best_records(spark):
    """The order of whole values fixes p5_found, so no consensus runs there; in consensus_names the consensus changes the survivor."""
    rows = [("k", "Acme Taxis", 5, None, "AB1 2CD", "e", None, "x"), ("k", "Acme West Taxis", 3, None, None, "e", None, "x"), ("k", "ACME WEST TAXIS.", 3, None, None, "f", None, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    best = S.best_records(df)
    assert [tuple(r) for r in best.collect()] == [("k", "Acme Taxis", "AB1 2CD")]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "Aggregate" in plan
    assert [tuple(r) for r in S.consensus_names(df).collect()] == [("k", "ACME WEST TAXIS", "ACME WEST TAXIS.")]
    random.seed(3)
    for _ in range(500):
        entries = sorted({(-random.randint(0, 3), 0, v, v) for _ in range(6) if (v := " ".join(random.choices(["ACME", "ACMS", "WEST", "LTD", "TAXIS"], k=random.randint(1, 4))))})
        assert S.closest_to_consensus(entries) == entries[0]
