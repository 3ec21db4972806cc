"""Column builders for names, numbers, dates, amounts and postcodes.  All stay in the JVM; none is a Python UDF."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[ \t\n\f\r]"
# The idioms that mark a payee as withheld, titles that mark an individual, the full postcode's form.
REDACTION = r"REDACTED|REDACTION|PERSONAL INFORMATION|PERSONAL DATA|WITHHELD|NOT DISCLOSED|PRIVATE INDIVIDUAL|(?<![A-Z0-9_])INDIVIDUAL(?![A-Z0-9_])|^PRIVATE\z"
INDIVIDUAL = r"^(MR|MRS|MS|MISS|DR|PROF)[ .]"
WITHHELD_LABEL = "Individual — name withheld"
POSTCODE = r"^[A-Z]{1,2}[0-9][A-Z0-9]?[0-9][A-Z]{2}\z"
SHEET_EPOCH = "1899-12-30"


@cache
def accent_table() -> tuple[str, str]:
    """All characters whose canonical decomposition is one ASCII character and marks, and those ASCII characters."""
    pairs = []
    for code in range(0x80, 0x10000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] < "\x80" and all(unicodedata.category(c).startswith("M") for c in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def blank_to_null(value: Column) -> Column:
    """The text without blanks around it, NULL if nothing is left."""
    return F.nullif(F.regexp_replace(value, rf"^{_WS}+|{_WS}+\z", ""), F.lit(""))


# What normalising a name does, in this order (signs, trading styles, hyphens, blanks, leading article, legal forms), and the register's number forms.
NAME_STEPS = (
    (r"[^\x00-\x7F]", " "), ("&", " AND "), (rf"{_WS}+(T{_WS}*/{_WS}*A|T{_WS}*\\{_WS}*A|TRADING{_WS}+AS){_WS}+.*\z", ""), (r"[^A-Z0-9 \t\n\f\r-]", " "),
    (rf"(^|{_WS})-+", " "), (rf"-+({_WS}|\z)", " "), (rf"{_WS}+", " "), (r"^ | \z", ""), (r"^THE ", ""), (r" PUBLIC LIMITED COMPANY\z", " PLC"), (r" LIMITED LIABILITY PARTNERSHIP\z", " LLP"), (r" LIMITED\z", " LTD"),
)
SHORT_NUMBER, SCOTTISH_FORM, SOCIETY_PREFIX, SOCIETY_REST, DOUBLE_PREFIX = r"^[A-Z]{2}[0-9]{1,6}\z", r"^[A-Z]{2}[0-9]{5}[A-Z]\z", r"^(IP|RS|SP)", r"^.{2}[0-9]+[A-Z]{2,}\z", r"^IPIP[0-9]{3}[A-Z0-9]\z"


def normalise_name(raw: Column) -> Column:
    """A name in capitals without marks, signs, trading style and leading THE, legal forms in short; NULL if nothing is left.

    The trading style goes before signs do, since its slash is what tells it; hyphens stay only inside words.
    """
    marked, plain = accent_table()
    v = F.regexp_replace(F.translate(F.upper(F.coalesce(raw, F.lit(""))), marked, plain), r"\p{M}", "")
    for pattern, to in NAME_STEPS:
        v = F.regexp_replace(v, pattern, to)
    return F.nullif(F.trim(v), F.lit(""))


def name_core(norm: Column) -> Column:
    """A normalised name without its legal form; a name that is only a legal form keeps it, as the form needs a word before it."""
    return F.nullif(F.trim(F.regexp_replace(norm, rf"{_WS}+(LTD|PLC|LLP)\z", "")), F.lit(""))


def legal_suffix(norm: Column) -> Column:
    """LTD, PLC or LLP at the end of a normalised name, else NULL."""
    return F.nullif(F.regexp_extract(norm, rf"{_WS}(LTD|PLC|LLP)\z", 1), F.lit(""))


def canon_company_number(raw: Column) -> Column:
    """A register number in its eight characters, or NULL where that would be a guess."""
    v = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), rf"{_WS}|[\"']", ""))
    bare = F.regexp_replace(v, "^0+", "")
    return (
        F.when(v.rlike(r"^0*\z"), None)
        .when(v.rlike(r"^[0-9]+\z"), F.when(F.length(bare) <= 8, F.lpad(bare, 8, "0")))
        .when(v.rlike(SHORT_NUMBER), F.concat(F.substring(v, 1, 2), F.lpad(F.regexp_replace(F.substring(v, 3, 8), "^0+", ""), 6, "0")))
        # societies: eight characters, of which a prefix, figures and then letters
        .when(v.rlike(SCOTTISH_FORM) | v.rlike(DOUBLE_PREFIX) | ((F.length(v) == 8) & v.rlike(SOCIETY_PREFIX) & v.rlike(SOCIETY_REST)), v)
    )


def parse_date(text: Column) -> Column:
    """The day a text states by one of eight forms, the first that fits: day-first with slashes (also with a clock), named months, ISO, two-figure years and spreadsheet day numbers.

    Every form is guarded by its shape, so that a two-figure year is never read as a year of the first century.
    """
    v = F.trim(text)
    forms = (
        (r"^\d{1,2}/\d{1,2}/\d{4}\z", "d/M/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}\z", "d/M/yyyy H:m"), (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}\z", "d/M/yyyy H:m:s"),
        (r"^\d{1,2}-[A-Za-z]{3}-\d{2}\z", "d-MMM-yy"), (r"^\d{1,2}-[A-Za-z]{3}-\d{4}\z", "d-MMM-yyyy"), (r"^\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d"), (r"^\d{1,2}/\d{1,2}/\d{2}\z", "d/M/yy"),
    )
    read = [F.when(v.rlike(shape), F.try_to_timestamp(F.initcap(v) if "MMM" in form else v, F.lit(form)).cast("date")) for shape, form in forms]
    serial = F.when(v.rlike(r"^\d{5}\z"), F.date_add(F.lit(SHEET_EPOCH).cast("date"), F.regexp_extract(v, r"^(\d{5})\z", 1).try_cast("int")))
    return F.coalesce(*read, serial)


def parse_amount(text: Column) -> Column:
    """The amount in a text: accounting parentheses are negative, currency signs, commas and blanks are dropped; NULL if it is no number."""
    v = F.regexp_replace(text, rf"^{_WS}+|{_WS}+\z", "")
    inside = F.regexp_replace(v, r"[^0-9.]", "").try_cast("decimal(38,9)")
    return F.when(v.rlike(r"^\(.*\)\z"), -inside).otherwise(F.regexp_replace(v, r"[^0-9.\-]", "").try_cast("decimal(38,9)"))


def is_redacted(name: Column) -> Column:
    """Whether a payee's name says that the payee is withheld; a NULL name doesn't."""
    return F.upper(F.coalesce(name, F.lit(""))).rlike(REDACTION)


def clean_postcode(text: Column) -> Column:
    """A full postcode in capitals without blanks, NULL for anything else."""
    v = F.upper(F.regexp_replace(text, rf"{_WS}", ""))
    return F.when(v.rlike(POSTCODE), v)


def names_individual(name: Column) -> Column:
    return F.coalesce(F.upper(name).rlike(INDIVIDUAL) | name.contains("@"), F.lit(False))


def mask_individual(name: Column, resolved: Column) -> Column:
    """The name, or a label instead where an unresolved name reads as a person's or an address."""
    return F.when(~resolved & names_individual(name), WITHHELD_LABEL).otherwise(name)


def surrogate_key(*parts: Column, separator: str = "|") -> Column:
    """SHA-256 in hex of the parts joined by a separator; NULL if any part is."""
    joined = [x for p in parts for x in (F.lit(separator), p.cast("string"))][1:]
    return F.sha2(F.concat(*joined), 256)


def non_blank_fields(*fields: Column) -> Column:
    """How many fields hold more than blanks."""
    return F.size(F.filter(F.array(*[f.cast("string") for f in fields]), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""))


def classify(value: Column, classes: dict[str, str], default: str | None = None) -> Column:
    """The class of an exact value; without a default an unknown value is NULL, so that a slip shows instead of hiding."""
    out = F.try_element_at(F.create_map(*[F.lit(x) for kv in classes.items() for x in kv]), value)
    return out if default is None else F.coalesce(out, F.lit(default))


def redaction_safe(name: Column, label: str = "[name not shown]") -> Column:
    """A payee name only where it is itself a redaction text, else a label."""
    return F.when(is_redacted(name), name).otherwise(label)
