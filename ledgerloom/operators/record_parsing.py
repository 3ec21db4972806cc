"""Raw CSV records split into fields, or rejected with a reason and the byte offset of the fault.

A quote-aware finite-state machine runs over the bytes of a whole batch of records at once.  The batch is cut into
chunks of equal length; for every chunk the machine is run from each of its states in step (one vector operation per byte
position for all chunks), which gives the chunk's state transition.  Composing these transitions from chunk to chunk
gives the state at each chunk's start, and a second run in step gives the state at every byte.  Chunks may cut a record
anywhere.  A record's end is a byte class of its own, so that no fault can leak into the next record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import canon_company_number, parse_date
from ledgerloom.operators.skew import checked_join, fence, let
from ledgerloom.operators.timestamps import LONG_MONTHS, MONTHS

# States: at the start of a field, in a bare field, inside quotes, after a quote inside quotes, after a fault.
START, BARE, QUOTED, CLOSED, FAULT = range(5)
# Byte classes.
OTHER, COMMA, QUOTE, END = range(4)
_NEXT = np.empty((4, 5), dtype=np.uint8)
_NEXT[OTHER] = (BARE, BARE, QUOTED, FAULT, FAULT)
_NEXT[COMMA] = (START, START, QUOTED, START, FAULT)
_NEXT[QUOTE] = (QUOTED, FAULT, CLOSED, QUOTED, FAULT)
_NEXT[END] = (START,) * 5
_CHUNK = 512

OUT = pa.struct([("fields", pa.list_(pa.string())), ("fault_at", pa.int32())])


def byte_states(classes: np.ndarray, chunk: int = _CHUNK) -> np.ndarray:
    """The machine's state before each byte, from START, for an array of byte classes."""
    n = len(classes)
    if n == 0:
        return np.empty(0, dtype=np.uint8)
    rows = -(-n // chunk)
    padded = np.full(rows * chunk, END, dtype=np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(rows, chunk).T)
    flat = _NEXT.ravel()
    moves = np.repeat(np.arange(5, dtype=np.uint8)[:, None], rows, axis=1)
    for column in steps:
        moves = flat[column * 5 + moves]
    first = np.empty(rows, dtype=np.uint8)
    state = START
    for k in range(rows):
        first[k] = state
        state = moves[state, k]
    before = np.empty_like(steps)
    now = first
    for k, column in enumerate(steps):
        before[k] = now
        now = flat[column * 5 + now]
    return before.T.ravel()[:n]


def tokenize(records: list[bytes | None]) -> tuple[list[list[str] | None], list[int | None]]:
    """Fields of each record, or None and the byte offset of the first misplaced quotation mark (of the opening one, if unclosed)."""
    sizes = np.fromiter((len(r) if r is not None else 0 for r in records), dtype=np.int64, count=len(records))
    ends = np.cumsum(sizes + 1) - 1
    data = np.frombuffer(b"\0".join(r or b"" for r in records) + b"\0", dtype=np.uint8) if len(records) else np.empty(0, dtype=np.uint8)
    classes = np.zeros(len(data), dtype=np.uint8)
    classes[data == 0x2C] = COMMA
    classes[data == 0x22] = QUOTE
    classes[ends] = END
    before = byte_states(classes)
    starts = ends - sizes
    fault = np.full(len(records), -1, dtype=np.int64)
    entering = np.flatnonzero((before != FAULT) & (classes != END) & (_NEXT[classes, before] == FAULT))
    owner = np.searchsorted(ends, entering)
    # after a closing quote the mark itself is the one that doesn't close; in a bare field it is the byte at hand
    at = np.where(before[entering] == CLOSED, entering - 1, entering)
    fault[owner[::-1]] = (at - starts[owner])[::-1]
    open_ends = np.flatnonzero(before[ends] == QUOTED)
    if len(open_ends):
        opening = np.flatnonzero((classes == QUOTE) & (before == START))
        fault[open_ends] = opening[np.searchsorted(opening, ends[open_ends]) - 1] - starts[open_ends]
    cuts = np.flatnonzero((classes == COMMA) & ((before == START) | (before == BARE) | (before == CLOSED)))
    low, high = np.searchsorted(cuts, starts), np.searchsorted(cuts, ends)
    quoted = np.add.reduceat((classes == QUOTE).astype(np.int64), starts) if len(records) else np.empty(0)
    fields: list[list[str] | None] = []
    for k, record in enumerate(records):
        if record is None or fault[k] >= 0:
            fields.append(None)
        elif quoted[k] == 0:
            fields.append(record.decode("utf-8", "replace").split(","))
        else:
            bounds = [-1, *(cuts[low[k] : high[k]] - starts[k]), len(record)]
            parts = [record[a + 1 : b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            fields.append([(p[1:-1].replace(b'""', b'"') if p[:1] == b'"' else p).decode("utf-8", "replace") for p in parts])
    return fields, [int(f) if f >= 0 else None for f in fault]


def parse_records(df: DataFrame, record: str = "raw_record") -> DataFrame:
    """``df`` with ``fields`` (array of text) and ``fault_at`` (byte offset of a quoting fault; then ``fields`` is NULL).

    One line end after the record is not part of it; line breaks inside quotes are kept.  A NULL record gives NULL in
    both; an empty one is a single empty field.  Records of any length are read whole.  A byte-order mark at the
    start is no content.  Columns of the input named fields or fault_at are replaced.
    """
    df = df.drop("fields", "fault_at")
    schema = df.withColumns({"fields": F.array(F.lit("")), "fault_at": F.lit(0)}).schema
    for f in schema.fields:
        f.nullable = True
    schema["fields"].dataType.containsNull = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(record)).to_pylist()
            raw = [None if t is None else (t[:-2] if t.endswith("\r\n") else t[:-1] if t.endswith(("\n", "\r")) else t).removeprefix("\ufeff").encode() for t in texts]
            fields, fault = tokenize(raw)
            columns = [*batch.columns, pa.array(fields, type=pa.list_(pa.string())), pa.array(fault, type=pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "fields", "fault_at"])

    return df.mapInArrow(run, schema)


def valid_number(value: Column) -> Column:
    """Whether a register number is 1 to 8 digits (not all zero) or two letters and 1 to 6 digits, blanks around and case aside."""
    v = F.upper(F.regexp_replace(value, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.coalesce((v.rlike(r"^[0-9]{1,8}$") & v.rlike("[1-9]")) | v.rlike(r"^[A-Z]{2}[0-9]{1,6}$"), F.lit(False))


def valid_amount(value: Column) -> Column:
    """Whether a spend amount is a number, whatever its pound sign, thousands commas, blanks, minus or accounting parentheses."""
    v = F.regexp_replace(value, r"[\s\u00a0,£]", "")
    return F.coalesce(v.rlike(r"^(-?\(?-?(\d+(\.\d*)?|\.\d+)-?\)?-?)$") & ~v.rlike(r"^[^(]*\)|^\([^)]*$"), F.lit(False))


def valid_day(value: Column) -> Column:
    """Whether a text is a day that exists, day before month; a time of day after it is ignored."""
    slash, named, iso = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})([ T].*)?$", r"^(\d{1,2})[- ]([A-Za-z]{3,9})[- ,]+(\d{4}|\d{2})([ T].*)?$", r"^(\d{4})[/-](\d{1,2})[/-](\d{1,2})([ T].*)?$"
    months = F.create_map(*[F.lit(x) for i, (a, b) in enumerate(zip(MONTHS, LONG_MONTHS, strict=True)) for x in ([a, i + 1] if a == b else [a, i + 1, b, i + 1])], F.lit("sept"), F.lit(9))
    year = lambda y: F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y).cast("int")
    g = F.regexp_extract

    def parts(v: Column) -> Column:
        return (
            F.when(v.rlike(slash), F.array(year(g(v, slash, 3)), g(v, slash, 2).cast("int"), g(v, slash, 1).cast("int")))
            .when(v.rlike(named), F.array(year(g(v, named, 3)), F.try_element_at(months, F.lower(g(v, named, 2))), g(v, named, 1).cast("int")))
            .when(v.rlike(iso), F.array(g(v, iso, 1).cast("int"), g(v, iso, 2).cast("int"), g(v, iso, 3).cast("int")))
        )

    def exists(p: Column) -> Column:
        leap = (p[0] % 4 == 0) & ((p[0] % 100 != 0) | (p[0] % 400 == 0))
        days = F.element_at(F.array(*[F.lit(n) for n in (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), F.greatest(F.lit(1), F.least(F.lit(12), p[1])))
        return p[1].between(1, 12) & (p[2] >= 1) & (p[2] <= days + F.when(leap & (p[1] == 2), 1).otherwise(0)) & (p[0] >= 1)

    trimmed = F.regexp_replace(value, r"^[\s\u00a0]+|[\s\u00a0]+$", "")
    return F.coalesce(let(let(trimmed, parts), exists), F.lit(False))


#: Columns that are checked: kind -> headings (without blanks, in small letters) and the test of a value.
CHECKS = {
    "number": (("companynumber",), valid_number),
    "date": (("incorporationdate", "paymentdate", "date", "datepaid"), valid_day),
    "amount": (("amount", "netamount", "£"), valid_amount),
}


def classify_records(df: DataFrame, record: str = "raw_record", file: str = "source_file", row: str = "row_num") -> DataFrame:
    """The records after each file's header with ``fields``, ``fault_at``, ``checked`` (the texts of the checked columns) and ``reason`` (NULL for a valid record).

    reason is the first that holds: 'quoting', 'column_count' (another number of fields than the file's header), or
    'bad_value' (a checked column whose value fails its test; an empty value of such a column fails).  A file's header is
    its row 0 (the smallest text, if it is repeated); without one, or with an unreadable one, columns can't be counted
    or named and only quoting is judged.  A NULL record is 'column_count'.
    """
    df = df.drop("fields", "fault_at", "checked", "reason")
    parsed = parse_records(df, record)
    keyed = F.transform("fields", lambda h: F.lower(F.regexp_replace(h, r"[\s\u00a0\ufeff]+", "")))
    # F.array_position is 1-based and 0 where absent
    places = [F.greatest(*[F.array_position("_keys", h) for h in names]).cast("int").alias(f"_at_{kind}") if len(names) > 1 else F.array_position("_keys", names[0]).cast("int").alias(f"_at_{kind}") for kind, (names, _) in CHECKS.items()]
    heads = parse_records(df.where(F.col(row) == 0).groupBy(file).agg(F.min(record).alias(record)), record)
    heads = heads.withColumn("_keys", keyed).select(file, F.size("fields").alias("_width"), *places)
    lines = checked_join(parsed.where(F.col(row) > 0), heads, [file], "left")
    bad = F.lit(False)
    for kind, (_, test) in CHECKS.items():
        at = F.col(f"_at_{kind}")
        bad = bad | F.coalesce((at > 0) & ~test(F.try_element_at("fields", at)), F.lit(False))
    reason = (
        F.when(F.col("fault_at").isNotNull(), "quoting")
        .when(F.col("fields").isNull() | F.coalesce((F.col("_width") > 0) & (F.size("fields") != F.col("_width")), F.lit(False)), "column_count")
        .when(bad, "bad_value")
    )
    checked = F.struct(*[F.when(F.col(f"_at_{kind}") > 0, F.try_element_at("fields", F.col(f"_at_{kind}"))).alias(kind) for kind in CHECKS])
    return fence(lines.select(*df.columns, "fields", "fault_at", checked.alias("checked"), reason.alias("reason")), ["reason"])


def typed_records(classified: DataFrame) -> DataFrame:
    """The valid records with their checked columns typed: ``company_number``, ``day`` and ``amount``, NULL where a file has no such column."""
    number = F.upper(F.regexp_replace("checked.number", r"[\s\u00a0]", ""))
    bare = F.regexp_replace("checked.amount", r"[\s\u00a0,£]", "")
    amount = F.regexp_replace(bare, r"[()-]", "").try_cast("decimal(18,2)") * F.when(bare.rlike(r"^\(|-"), -1).otherwise(1)
    typed = [canon_company_number(number).alias("company_number"), parse_date(F.regexp_replace("checked.date", r"^[\s\u00a0]+|[\s\u00a0]+$", "")).alias("day"), amount.cast("decimal(18,2)").alias("amount")]
    return classified.where("reason IS NULL").drop("fault_at", "reason", "company_number", "day", "amount").select("*", *typed).drop("checked")
