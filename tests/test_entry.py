"""Every query against its SQL at the smallest scale, as the driver does at a larger one."""

import decimal
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v else "0"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


def core_queries():
    from ledgerloom.plans import catalogue, general, raw_catalogue  # noqa: F401

    return {**general.QUERIES, **catalogue.QUERIES}


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in entry.oracle_sql():
        r = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == columns
        want = sorted((tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall()), key=repr)
        assert got == want
    if name.endswith("controls"):
        assert not [r for r in df.collect() if r["severity"] == "HARD" and r["verdict"] != "PASS"]
    spark.catalog.clearCache()


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_without_llm():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "ledgerloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(from|import) ledgerloom\.llm", p.read_text(), re.M), p
