from datetime import date, timedelta
import random

from ledgerloom.operators import asof

NAMES = "company_number string, k int, name string, condate date, recorded_on date"


def test_known_at_the_time_by_brute_force(spark):
    random.seed(4)
    day = lambda n: date(2024, 1, 1) + timedelta(n)
    names = [(f"c{random.randint(0, 9)}", random.randint(1, 4), f"n{random.randint(0, 99)}", day(random.randint(0, 200)) if random.random() < 0.9 else None, day(random.randint(0, 250)) if random.random() < 0.5 else None) for _ in range(60)]
    names += names[:5] + [("c1", 1, None, day(50), None), (None, 1, "x", day(50), None)]
    spend = [(f"s{k}", day(random.randint(0, 260)) if random.random() < 0.95 else None, "clash") for k in range(400)]
    links = [(f"s{k}", "key", "c0" if k % 3 else f"c{random.randint(0, 11)}") for k in range(400)] * 2
    firms = [(f"c{k}", day(20) if k % 2 else None) for k in range(8)]

    def truth(paid, company):
        born = dict(firms).get(company)
        if paid is None or (born and paid < born):
            return None
        versions = [(max(c, r or c), -k, n) for num, k, n, c, r in names if num == company and c and n]
        after = [v for v in versions if v[0] > paid]
        return min(after)[2] if after else None

    paid = {s: p for s, p, _ in spend}
    want = {(s, truth(paid[s], c)) for s, _, c in links if truth(paid[s], c)}
    old, asof.BUCKET_ROWS = asof.BUCKET_ROWS, 40
    try:
        out = asof.names_as_known(spark.createDataFrame(spend, "spend_id string, payment_date date, name string"), spark.createDataFrame(links, "spend_id string, supplier_key string, company_number string"),
                                  spark.createDataFrame(names, NAMES), spark.createDataFrame(firms, "company_number string, incorporation_date date"))
        assert {tuple(r) for r in out.collect()} == want
    finally:
        asof.BUCKET_ROWS = old


def test_empty(spark):
    empty = lambda s: spark.createDataFrame([], s)
    assert asof.names_as_known(empty("spend_id string, payment_date date"), empty("spend_id string, company_number string"), empty(NAMES), empty("company_number string, incorporation_date date")).count() == 0
