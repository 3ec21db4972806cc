import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators import record_parsing as rp


def brute(record: bytes):
    """One record by one, byte by byte."""
    state, at, opened, fields, now = "start", None, None, [], bytearray()
    for k, b in enumerate(record):
        c = chr(b)
        if state == "start":
            if c == '"':
                state, opened = "quoted", k
            elif c == ",":
                fields.append(bytes(now))
                now = bytearray()
            else:
                state = "bare"
                now.append(b)
        elif state == "bare":
            if c == '"':
                return None, k
            if c == ",":
                fields.append(bytes(now))
                now, state = bytearray(), "start"
            else:
                now.append(b)
        elif state == "quoted":
            if c == '"':
                state = "closed"
            else:
                now.append(b)
        elif c == '"':
            now.append(b)
            state = "quoted"
        elif c == ",":
            fields.append(bytes(now))
            now, state = bytearray(), "start"
        else:
            return None, k - 1
    if state == "quoted":
        return None, opened
    return [f.decode("utf-8", "replace") for f in [*fields, bytes(now)]], None


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n é', max_size=40), min_size=1, max_size=30), st.integers(1, 9))
def test_machine_equals_brute_force(records, chunk):
    raw = [r.encode() for r in records]
    old, rp._CHUNK = rp._CHUNK, chunk
    try:
        fields, faults = rp.tokenize(raw)
    finally:
        rp._CHUNK = old
    assert list(zip(fields, faults, strict=True)) == [brute(r) for r in raw]


def test_chunks_compose_to_the_same_states():
    rng = np.random.default_rng(1)
    classes = rng.choice(4, size=5_000, p=[0.6, 0.2, 0.15, 0.05]).astype(np.uint8)
    whole = rp.byte_states(classes, 5_000)
    for chunk in (1, 7, 64, 4_999):
        assert (rp.byte_states(classes, chunk) == whole).all()


def test_reasons(spark):
    head = "CompanyName, CompanyNumber,IncorporationDate"
    rows = [("f", 0, head), ("f", 1, "A,12345678,01/02/2003"), ("f", 2, 'A "x",1,01/02/2003'), ("f", 3, "A,1"), ("f", 4, "A,00000000,01/02/2003"), ("f", 5, "A,sc123,29/02/2023"), ("f", 6, '"A, B\nC", sc123 ,29/02/2024\r\n'), ("f", 7, '"A,1,01/02/2003'), ("f", 8, None), ("f", 9, ""),
            ("g", 0, "Payee,Date, £ "), ("g", 1, 'X,1-Jan-24,"£1,234.50"'), ("g", 2, "X,1-Jan-24,(12.50)"), ("g", 3, "X,1-Jan-24,1O5.00"), ("g", 4, "X,31/04/2024,5"), ("g", 5, "X,,5"), ("g", 6, "X,1-Jan-24,-£5"), ("g", 7, "X,1-Jan-24,"), ("h", 1, "no,header"), (None, 2, "a,b")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "source_file string, row_num bigint, raw_record string, fields string, reason string")
    got = {(r["source_file"], r["row_num"]): r["reason"] for r in rp.classify_records(df).collect()}
    assert got == {("f", 1): None, ("f", 2): "quoting", ("f", 3): "column_count", ("f", 4): "bad_value", ("f", 5): "bad_value", ("f", 6): None, ("f", 7): "quoting", ("f", 8): "column_count", ("f", 9): "column_count",
                   ("g", 1): None, ("g", 2): None, ("g", 3): "bad_value", ("g", 4): "bad_value", ("g", 5): "bad_value", ("g", 6): None, ("g", 7): "bad_value", ("h", 1): None, (None, 2): None}
    assert rp.classify_records(df.limit(0)).count() == 0
    typed = {(r["source_file"], r["row_num"]): (r["company_number"], str(r["day"]), None if r["amount"] is None else str(r["amount"])) for r in rp.typed_records(rp.classify_records(df)).collect()}
    assert typed[("f", 6)] == ("SC000123", "2024-02-29", None) and typed[("g", 1)] == (None, "2024-01-01", "1234.50") and typed[("g", 2)][2] == "-12.50" and typed[("g", 6)][2] == "-5.00" and len(typed) == 7


def test_long_records():
    random.seed(2)
    long = ",".join('"' + "x" * random.randint(0, 50) + '""y"' for _ in range(20_000)).encode()
    assert rp.tokenize([long, b"a,b"]) == ([brute(long)[0], ["a", "b"]], [None, None])
