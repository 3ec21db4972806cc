"""Files whose columns drift: one consistent table, and a report of each change between neighbouring files of a series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.components import cut
from ledgerloom.operators.skew import checked_join

# Headings known to feed the two fields, without blanks and in small letters; others are learnt from the files (``learnt_headings``).
FIELD_HEADINGS = {
    "expense_type_src": ("expensetype", "exptyp", "spendcategory", "costclassification", "natureofcost", "purposeofspending", "expenditureheading", "whatthemoneywasfor"),
    "supplier_postcode_src": ("supplierpostcode", "postcodeofpayee", "payeepostcode", "postalcode", "supppc", "locationcode", "vendoraddresscode"),
}

#: Raw types a value may have; 'number' is a bare number.
_NUMBER = r"^\s*[+-]?\d+(\.\d+)?\s*$"


def heading_key(heading: Column) -> Column:
    """A heading without blanks, byte-order marks, control characters and letter case; NULL stays NULL."""
    return F.lower(F.regexp_replace(heading, r"[\s\u00a0\u200b\ufeff\p{Cc}]+", ""))


def raw_type(value: Column) -> Column:
    """'number' (a bare number) or 'text'; NULL for a NULL or blank value."""
    return F.when(F.trim(value) == "", None).when(value.rlike(_NUMBER), "number").otherwise(F.when(value.isNotNull(), "text"))


def path_types(rows: DataFrame, file: str, paths: Sequence[str]) -> DataFrame:
    """Statistics per file, path and raw type of ``rows`` taken as path-value maps: (file, path, raw_type, n).

    Rows become maps from path to raw value, maps become (path, type) pairs, and the pairs are counted before they are
    shuffled, so a file with most of the rows costs one row per path and type.  NULL and blank values are not counted.
    """
    values = F.map_from_arrays(F.array(*[F.lit(p) for p in paths]), F.array(*[F.col(f"`{p}`").cast("string") for p in paths]))
    long = rows.select(F.col(f"`{file}`").alias("file"), F.explode(values).alias("path", "value"))
    typed = long.select("file", "path", raw_type(F.col("value")).alias("raw_type")).where("raw_type IS NOT NULL")
    return typed.groupBy("file", "path", "raw_type").agg(F.count(F.lit(1)).alias("n"))


def file_fields(headers: DataFrame, headings: Mapping[str, Sequence[str]] = FIELD_HEADINGS, filled: DataFrame | None = None) -> DataFrame:
    """For each file and field the heading that feeds it: (source_file, unit_code, period, field, heading, heading_text).

    A file without a column for a field has NULL headings there.  If several columns qualify, the leftmost counts (the
    smallest heading on equal positions); repeated header rows change nothing.  ``filled`` (source_file, field) names the
    files that hold values of a field; where such a file has none of the listed ``headings``, ``learnt_headings`` finds one.
    """
    fields = F.create_map(*[F.lit(x) for field, keys in headings.items() for k in keys for x in (k, field)], F.lit(""), F.lit(""))
    key = heading_key(F.col("header_text"))
    per_file = headers.groupBy("source_file", "unit_code", "period").agg(
        *[F.min(F.when(F.try_element_at(fields, key) == f, F.struct(F.col("col_pos").alias("pos"), key.alias("heading"), F.col("header_text").alias("heading_text")))).alias(f) for f in headings]
    )
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}.heading").alias("heading"), F.col(f"{f}.heading_text").alias("heading_text")) for f in headings])
    listed = per_file.select("source_file", "unit_code", "period", F.inline(pairs))
    if filled is None:
        return listed
    columns = headers.select("source_file", key.alias("heading"), "header_text", "col_pos").where(F.try_element_at(fields, key).isNull())
    learnt = learnt_headings(columns, listed.where("heading IS NOT NULL").select("source_file", "field").distinct(), filled)
    both = listed.join(learnt.select("source_file", "field", F.col("heading").alias("_h"), F.col("heading_text").alias("_t")).hint("merge"), ["source_file", "field"], "left")
    return both.select("source_file", "unit_code", "period", "field", F.coalesce("heading", "_h").alias("heading"), F.coalesce("heading_text", "_t").alias("heading_text"))


def learnt_headings(columns: DataFrame, listed: DataFrame, filled: DataFrame) -> DataFrame:
    """(source_file, field, heading, heading_text) for files with values of a field but without a listed heading for it.

    A heading of ``columns`` (source_file, heading, header_text, col_pos) can feed a field if every file that has it holds values of
    the field and none of them has a listed heading for it (``listed``: source_file, field).  Of several in a file, the one
    wins that most often is the only one, then the one of most files, then the smallest.  All tables have one row per file and
    heading at most; data rows were counted before.  They grow with the files, so none is broadcast.
    """
    own = columns.groupBy("source_file", "heading").agg(F.min(F.struct("col_pos", "header_text")).alias("_c")).select("source_file", "heading", F.col("_c.header_text").alias("heading_text"))
    files = own.groupBy("heading").agg(F.count(F.lit(1)).alias("n"))
    open_ = filled.select("source_file", "field").distinct().join(listed.hint("merge"), ["source_file", "field"], "left_anti")
    seen = own.join(open_.hint("merge"), "source_file")
    pure = seen.groupBy("heading", "field").agg(F.count(F.lit(1)).alias("m")).join(files.hint("merge"), "heading").where("m = n").select("heading", "field", "n")
    able = seen.join(pure.hint("merge"), ["heading", "field"])
    rivals = able.groupBy("source_file", "field").agg(F.count(F.lit(1)).alias("rivals"))
    alone = able.join(rivals.hint("merge"), ["source_file", "field"]).groupBy("heading", "field").agg(F.count_if(F.col("rivals") == 1).alias("alone"))
    best = F.min(F.struct((-F.col("alone")).alias("a"), (-F.col("n")).alias("b"), "heading", "heading_text"))
    return able.join(alone.hint("merge"), ["heading", "field"]).groupBy("source_file", "field").agg(best.alias("_b")).select("source_file", "field", "_b.heading", "_b.heading_text")


def drift_report(headers: DataFrame, rows: DataFrame, file: str = "_source_file", headings: Mapping[str, Sequence[str]] = FIELD_HEADINGS) -> DataFrame:
    """Each change of a field between a file and the file of its series' next earlier period.

    Columns source_file, field, change ('added', 'removed', 'renamed', 'retyped'), before, after.  'retyped' holds if both
    files have a column for the field and most values are bare numbers in one but not in the other; a file without
    values has no type, so nothing is retyped against it.  Headings outside the list are told by the files that hold values
    (``learnt_headings``), so a new name is a renaming and not a loss.  The first file of a series, files with a NULL unit or
    period and empty inputs report nothing.  The window runs over one row per file and field, never over data rows.
    """
    stats = path_types(rows, file, list(headings)).groupBy("file", "path").agg(F.sum(F.when(F.col("raw_type") == "number", F.col("n")).otherwise(0)).alias("numbers"), F.sum("n").alias("n"))
    typed = cut(stats.select(F.col("file").alias("source_file"), F.col("path").alias("field"), (F.col("numbers") * 2 > F.col("n")).alias("numeric")))
    fields = file_fields(headers.where("unit_code IS NOT NULL AND period IS NOT NULL"), headings, typed).join(typed.hint("merge"), ["source_file", "field"], "left")
    before = Window.partitionBy("unit_code", "field").orderBy("period", "source_file")
    pairs = fields.select(
        "source_file", "field", "heading", "heading_text", "numeric", F.row_number().over(before).alias("_k"),
        F.lag("heading").over(before).alias("heading0"), F.lag("heading_text").over(before).alias("heading_text0"), F.lag("numeric").over(before).alias("numeric0"),
    ).where("_k > 1")
    has, had = F.col("heading").isNotNull(), F.col("heading0").isNotNull()
    label = lambda c: F.when(c, "number").otherwise(F.when(c.isNotNull(), "text"))
    change = lambda name, cond, a, b: F.when(cond, F.struct(F.lit(name).alias("change"), a.alias("before"), b.alias("after")))
    text0, text1 = F.col("heading_text0"), F.col("heading_text")
    changes = F.array_compact(F.array(
        change("added", has & ~had, text0, text1),
        change("removed", had & ~has, text0, text1),
        change("renamed", has & had & (F.col("heading") != F.col("heading0")), text0, text1),
        change("retyped", has & had & (F.col("numeric") != F.col("numeric0")), label(F.col("numeric0")), label(F.col("numeric"))),
    ))
    return pairs.select("source_file", "field", F.inline(changes))


def unify(rows: DataFrame, types: Mapping[str, str], file: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with each column of ``types`` cast to its target beside its raw text, and the failed casts per file.

    The table has ``<column>_typed`` next to every column; a value that doesn't cast is NULL there and is counted in the
    report (file, column, type, failed, example), the example being the smallest failing text.  Blank and NULL values are
    NULL without a failure.  No row is dropped.
    """
    taken = set(rows.columns)
    name = {c: next(n for n in (f"{c}_typed", f"{c}_typed_as", f"_{c}_typed") if n not in taken) for c in types}
    cast = {c: F.expr(f"try_cast(nullif(trim(cast(`{c}` AS string)), '') AS {t})") for c, t in types.items()}
    table = rows.select("*", *[cast[c].alias(name[c]) for c in types])
    failed = {c: cast[c].isNull() & (F.trim(F.col(f"`{c}`").cast("string")) != "") for c in types}
    cells = F.array(*[F.when(failed[c], F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"`{c}`").cast("string").alias("value"))) for c, t in types.items()])
    report = rows.select(F.col(f"`{file}`").alias("file"), F.inline(F.array_compact(cells))).groupBy("file", "column", "type").agg(F.count(F.lit(1)).alias("failed"), F.min("value").alias("example"))
    return table, report


def unified_table(headers: DataFrame, rows: DataFrame, file: str = "_source_file", headings: Mapping[str, Sequence[str]] = FIELD_HEADINGS) -> DataFrame:
    """Every row with the heading that fed each field: ``rows`` plus ``<field>_heading`` (NULL where the file has none)."""
    fields = file_fields(headers, headings)
    per_file = fields.groupBy(F.col("source_file").alias(file)).agg(*[F.max(F.when(F.col("field") == f, F.col("heading_text"))).alias(f"{f}_heading") for f in headings])
    return checked_join(rows.drop(*[f"{f}_heading" for f in headings]), per_file, [file], "left")
