import itertools
import random

import pytest

from ledgerloom.llm import metric, naming as N, variants

SPEND = "supplier_name_raw string, supplier_postcode_src string, is_redacted boolean, name string"
CONTRACTS = "supplier_name_raw string, code string"


def test_metric_join_equals_brute_force(spark, monkeypatch):
    random.seed(11)
    words = ["".join(random.choice("ABCD") for _ in range(random.randint(3, 9))) for _ in range(300)] + [None, "", "É" * 4, "É" * 3 + "A", "LONG" * 500, "LONG" * 500 + "X"]
    monkeypatch.setattr(metric, "HOME_BLOCK", 20)
    monkeypatch.setattr(metric, "VISITOR_BLOCK", 50)
    unique = sorted({w for w in words if w is not None})
    df = spark.createDataFrame([(w,) for w in words * 2], "text string")
    for radius in (1, 2):
        want = {(a, b) for a, b in itertools.combinations(unique, 2) if max(len(a), len(b)) < 100 and N.damerau(a, b, 99) <= radius} | {("LONG" * 500, "LONG" * 500 + "X")}
        assert {tuple(r) for r in metric.near_pairs(df, radius).collect()} == want
    assert metric.near_pairs(df.limit(0)).count() == 0 and metric.near_pairs(df.limit(1)).count() == 0


def test_distances_obey_the_triangle_inequality():
    random.seed(12)
    words = ["".join(random.choice("AB") for _ in range(random.randint(0, 6))) for _ in range(40)]
    d = metric.pivot_distances(words, words)
    assert all(d[i, j] == N.damerau(words[i], words[j], 99) for i in range(40) for j in range(40))
    assert all(d[i, k] <= int(d[i, j]) + int(d[j, k]) for i in range(40) for j in range(40) for k in range(40))


@pytest.mark.parametrize("a,b,want", [
    ("Acmeflor Training Ltd", "ACMEFLOR TRNG LIMITED", 2), ("Acmeflor Training Ltd", "training ltd, acmeflor", 2), ("Acmeflor Training Ltd", "Acmefolr Training Ltd.", 2), ("Acmeflor Training Ltd", "Acmeflor Training PLC", 0), ("Acmeflor Training Ltd", "Acmeflor Security Ltd", 0),
    ("Acmeflor Training Ltd", "The Acmeflor Training Ltd t/a Training Shop", 2), ("Acmeflor Training Ltd", "AcmeflorTraining L.T.D.", 2), ("Acmeflor Training Ltd", "Acmefl0r Training Limted (12345)", 2), ("Andrew Krakrilzu", "KRAKRILZU, A", 1), ("Andrew Krakrilzu", "Drew Krakrilzu", 2), ("Andrew Krakrilzu", "Anthony Krakrilzu", 0),
    ("Andrew Krakrilzu", "Krakrilzu, W. t/a Krakrilzu Security", 0), ("Acmeflor Moorwick Training Ltd", "Acmeflor Training Ltd", 3), ("Acmeflor and Zedral Training Limited", "Zedral & Acmeflor Trai", 2), ("Acmeflor and Zedralkor Training Limited", "Acmeflor and Zedralkor T", 1),
])
def test_two_spellings(a, b, want):
    common = {"TRAINING": 900, "SECURITY": 900, "SHOP": 500}
    v = N.Vocabulary(common)
    x, y = v.parse(a), v.parse(b)
    got = 2 if x.key == y.key else N.same_payee(x, y, common)
    assert got == want and (x.key == y.key or N.same_payee(y, x, common) == want)


def test_pairs(spark):
    trades = ["Training", "Security", "Joinery"]
    random.seed(13)
    firms = ["".join(random.choice(["bal", "kor", "tri", "zun", "fel", "dra"]) for _ in range(4)).title() for _ in range(60)]
    filler = [(f"{f} {t} Ltd", f"AB{k % 9}1 2C{'DEFGH'[k % 5]}", False, "x") for k, f in enumerate(firms) for t in trades[: 1 + k % 3]]
    rows = [("Quorzapel Training Ltd", "ZZ1 1ZZ", False, "x"), ("QUORZAPEL TRAINING LIMITED", None, False, "x"), ("Quorzapal Training Ltd", "zz11zz", None, "x"), ("Quorzapel Security Ltd", "ZZ1 1ZZ", False, "x"), ("Mary Vexilorum", "YY1 1YY", False, "x"), ("VEXILORUM, M", "YY1 1YY", False, "x"), ("Mark Vexilorum", "XX1 1XX", False, "x"),
            ("REDACTED", None, True, "x"), (None, None, False, "x"), ("  ", None, False, "x"), ("Quorzapel Training Ltd", None, False, "x")]
    got = {tuple(r) for r in variants.variant_pairs(spark.createDataFrame(filler + rows, SPEND), spark.createDataFrame([("Quorzapel Trainnig Ltd", "c"), (None, "c"), ("Quorzapel Trainnig Ltd", "c")], CONTRACTS)).collect()}
    group = ["Quorzapel Training Ltd", "QUORZAPEL TRAINING LIMITED", "Quorzapal Training Ltd", "Quorzapel Trainnig Ltd"]
    want = {tuple(sorted(p)) for p in itertools.combinations(group, 2)} | {("Mary Vexilorum", "VEXILORUM, M")}
    assert {p for p in got if "uorz" in p[0] + p[1] or "UORZ" in p[0] + p[1] or "exil" in p[0] + p[1]} == want
    assert variants.variant_pairs(spark.createDataFrame([], SPEND), spark.createDataFrame([], CONTRACTS)).count() == 0


def test_spellings_of_common_words_meet(spark, monkeypatch):
    # words that are common, but too seldom to resolve slips, stand in firms' and persons' names
    monkeypatch.setattr(variants, "LEAST_STRONG", 10_000)
    random.seed(14)
    part = lambda n: "".join(random.choice(["bal", "kor", "tri", "zun", "fel", "dra"]) for _ in range(n)).title()
    own = list(dict.fromkeys(part(6) for _ in range(60)))[:30]
    filler = [t for k, f in enumerate(own) for t in (f"Quorzapel {f} Ltd", f"{f} Training Ltd", f"{f} Birmingham Ltd", f"{f} International Ltd", f"Vexilorum {f} Ltd")]
    groups = [["QUORZAPEL TRAINING LTD", "Quorzapal Training Ltd", "Quorzapel Trainign Limited"], ["Mary Vexilorum", "VEXILORUM, M", "Mary Vexilorun"], ["Birmingham International Ltd", "BIRMINGHAM INTERNATIONAL", "Birmingham   Internation"]]
    rows = [(t, "ZZ1 1ZZ", False, "x") for t in filler + [t for g in groups for t in g]]
    got = {tuple(r) for r in variants.variant_pairs(spark.createDataFrame(rows, SPEND), spark.createDataFrame([], CONTRACTS)).collect()}
    want = {tuple(sorted(p)) for g in groups for p in itertools.combinations(g, 2)}
    ours = {t for g in groups for t in g}
    assert {p for p in got if ours & set(p)} == want


def test_frequent_words_join_in_blocks(spark, monkeypatch):
    # KORBAL stands in more classes than a block holds, and every class that has it also has a rarer word
    monkeypatch.setattr(variants, "BLOCK", 7, raising=False)
    monkeypatch.setattr(variants, "FREQUENT", 7, raising=False)
    core = {str(k): ["KORBAL", f"Z{chr(65 + k) * 4}"] for k in range(20)} | {"near": ["KORBAN"]}
    classes = spark.createDataFrame([(k, c, "", False, c, [], []) for k, c in core.items()], "key string, core array<string>, form string, cut boolean, rare array<string>, twos array<string>, begun array<string>")
    entries = getattr(variants, "dealt", lambda d: d)(variants.entry_words(classes))
    near = spark.createDataFrame([("KORBAL", "KORBAN")], "a string, b string")
    got = [(r["a_key"], r["b_key"]) for r in variants.candidate_pairs(entries, entries, near).where("a_key <> b_key").select("a_key", "b_key").collect()]
    assert sorted(got) == sorted(itertools.permutations(core, 2))
