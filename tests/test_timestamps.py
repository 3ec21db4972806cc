from datetime import UTC, datetime
from zoneinfo import ZoneInfo

from ledgerloom.operators.timestamps import choose_zones, normalise_moments, parse_moments, zone_violations

SCHEMA = "id int, t string, g string, seen timestamp, utc_micros string, zone_used string"


def micros(*parts, zone="UTC", us=0):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone)).astimezone(UTC).timestamp()) * 1_000_000 + us


CASES = [
    ("08-Mar-24 02:25 PM", micros(2024, 3, 8, 14, 25)), ("08-Jul-24 12:00 AM", micros(2024, 7, 8, 0, 0, zone="Europe/London")), ("20230602123244", micros(2023, 6, 2, 12, 32, 44, zone="Europe/London")),
    (" 06/07/2023 09:16 ", micros(2023, 7, 6, 9, 16, zone="Europe/London")), ("26 Mar 2023 01:38 CET", micros(2023, 3, 26, 0, 38)), ("27 Jun 2024 16:31 GMT", micros(2024, 6, 27, 16, 31)), ("17 Dec 2023 13:19 CEST", micros(2023, 12, 17, 11, 19)),
    ("1699701013", 1699701013_000000), ("1712865040959", 1712865040959_000), ("2023-08-21T13:45:20.051821", micros(2023, 8, 21, 13, 45, 20, zone="Europe/London", us=51821)), ("29 December 2023, 2.46pm", micros(2023, 12, 29, 14, 46)),
    ("2024-05-08T07:43:08+05:30", micros(2024, 5, 8, 2, 13, 8)), ("2023-09-02 19:13:33[Europe/Paris]", micros(2023, 9, 2, 17, 13, 33)), ("2024-03-02 11:41:28 Europe/Paris", micros(2024, 3, 2, 10, 41, 28)), ("20240519T141559Z", micros(2024, 5, 19, 14, 15, 59)),
    ("Fri, 17 May 2024 17:45:59 -0400", micros(2024, 5, 17, 21, 45, 59)), ("45458.578345", micros(2024, 6, 15, 13, 52, 49, zone="Europe/London")), ("2023-10-29 01:30:00", micros(2023, 10, 29, 0, 30)), ("2024-10-27T00:59:59Z", micros(2024, 10, 27, 0, 59, 59)),
    # no cases: a day alone, a time that never occurs, impossible parts, nothing
    ("14/01/2024", None), ("45522", None), ("2024-05-19", None), ("26/03/2023 01:30", None), ("31/02/2024 10:00", None), ("14/03/2024 25:10", None), ("2024-03-14T10:75:00Z", None), ("2024-01-01 10:00 Mars/Base", None), ("TBC", None), ("", None), ("   ", None), (None, None), ("9" * 5000, None),
]


def test_every_form(spark):
    df = spark.createDataFrame([(k, t, None, None, "clash", "clash") for k, (t, _) in enumerate(CASES)], SCHEMA)
    got = {r["id"]: r["utc_micros"] for r in normalise_moments(df, "t", ["g"], "seen").collect()}
    assert {CASES[k][0]: v for k, v in got.items()} == dict(CASES)


def test_rows_stay_and_empty_table(spark):
    df = spark.createDataFrame([(1, "2024-01-01 10:00:00", "a", None, "", "")] * 3, SCHEMA)
    out = normalise_moments(df, "t", ["g"], "seen")
    assert out.count() == 3 and out.columns == ["id", "t", "g", "seen", "utc_micros", "zone_used"]
    assert normalise_moments(df.limit(0), "t", ["g"], "seen").count() == 0


def test_history_is_estimated_from_arrival(spark):
    # a group whose lines arrive 90 minutes after their Paris wall clock can't be on London time
    rows = [(k, f"2024-01-{k + 1:02d} 12:00:00", "paris", datetime(2024, 1, k + 1, 11, 30), "", "") for k in range(20)]
    rows += [(k, f"2024-01-{k - 19:02d} 12:00:00", "london", datetime(2024, 1, k - 19, 18, 0), "", "") for k in range(20, 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    used = {(r["g"], r["zone_used"]) for r in normalise_moments(df, "t", ["g"], "seen").collect()}
    assert used == {("paris", "Europe/Paris"), ("london", "Europe/London")}
    zones = ["Europe/London", "Europe/Paris"]
    v = zone_violations(parse_moments(df, "t"), ["g"], "seen", zones)
    assert {r["g"]: (r["v0"], r["v1"]) for r in v.collect()} == {"paris": (20, 0), "london": (0, 0)}
    assert {r["g"]: r["zone"] for r in choose_zones(v, zones, least_gain=1.0).collect()} == {"paris": "Europe/London", "london": "Europe/London"}


def test_history_is_estimated_from_order(spark):
    # lines that follow a moment known from elsewhere by less than the zones' difference fix the history too
    rows = [(k, f"2024-01-{k + 1:02d} 12:00:00", "athens", None, datetime(2024, 1, k + 1, 9, 30), "") for k in range(20)] + [(k, f"2024-01-{k - 19:02d} 12:00:00", "london", None, datetime(2024, 1, k - 19, 11, 30), "") for k in range(20, 40)]
    df = spark.createDataFrame(rows, "id int, t string, g string, seen timestamp, after timestamp, x string")
    use = lambda **kw: {(r["g"], r["zone_used"]) for r in normalise_moments(df, "t", ["g"], "seen", **kw).collect()}
    assert use(prior="Europe/Athens", candidates=["Europe/London"], sequence="after") == {("athens", "Europe/Athens"), ("london", "Europe/London")}
    assert use(prior="Europe/Athens", candidates=["Europe/London"]) == {("athens", "Europe/Athens"), ("london", "Europe/Athens")}
