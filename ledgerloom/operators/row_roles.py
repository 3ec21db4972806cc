"""What each row of a published file is: a payment, a total, part of a reconciliation sheet, a copy in an annex, or a trailing leftover.

Rows are never removed.  Everything is judged inside one file by row number.  Per-file facts are aggregates; the one
running count works block by block of row numbers, so that a file with most of all rows is shared by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.skew import checked_join

#: Row numbers that one task counts through.
BLOCK_ROWS = 100_000
MARKER, STACK, PUBLISH = "RECONCILIATION TO STACK:", r"(?<![A-Z0-9_])STACK\z", "PUBLISH"


def running_count(df: DataFrame, condition: Column, file: str, row: str, name: str, block: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``name``: how many earlier rows of the same file fulfil ``condition``."""
    blocked = df.withColumn("_block", F.floor(F.col(row) / block)).withColumn("_hit", F.coalesce(condition, F.lit(False)))
    per_block = blocked.groupBy(file, "_block").agg(F.count_if("_hit").alias("_n"))
    earlier = Window.partitionBy(file).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_block.select(file, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(file, "_block").orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    return checked_join(blocked, starts, [file, "_block"]).withColumn(name, F.col("_start") + F.count_if("_hit").over(inside)).drop("_block", "_hit", "_start")


def workbook_roles(rows: DataFrame, file: str = "_source_file", row: str = "_row_num") -> DataFrame:
    """(file, row, wb_role) for the rows of workbooks: files with a reconciliation marker and a later row ending in STACK.

    Rows before the marker are the body, whose sections end with unnamed amounts; the section named PUBLISH between marker
    and stack (the first, if two are) holds the payments.  Rows after the stack are the annex.
    """
    name = F.upper(F.trim("supplier_name_raw"))
    marks = rows.where(name == MARKER).groupBy(file).agg(F.min(row).alias("recon"))
    marked = checked_join(rows, marks, [file])
    stacks = marked.where((F.col(row) > F.col("recon")) & name.rlike(STACK)).groupBy(file).agg(F.min(row).alias("stack"))
    book = checked_join(marked, stacks, [file])
    unnamed = F.coalesce(F.trim("supplier_name_raw"), F.lit("")) == ""
    total = unnamed & ~F.coalesce("is_redacted", F.lit(False)) & F.col("amount").isNotNull()
    book = running_count(book.select("*", unnamed.alias("_bare"), total.alias("_total")), total & (F.col(row) < F.col("recon")), file, row, "_section")
    labels = book.where((F.col(row) > F.col("recon")) & (F.col(row) < F.col("stack")) & ~F.col("_bare") & F.col("amount").isNotNull()).select(file, row, (name == PUBLISH).alias("_publish"))
    named = labels.where("_publish").groupBy(file).agg(F.min(row).alias("_at"))
    # sections count from 0 here on both sides: the totals, and the labels, before
    publish = labels.join(named, file).groupBy(file).agg(F.count_if(F.col(row) < F.col("_at")).alias("_publish"))
    header = F.col("_bare") & F.col("amount").isNull()
    body = F.when(F.col("_total"), "section_total").when(header, "section_header").when(F.col("_section") == F.col("_publish"), "transaction").otherwise("out_of_scope_section")
    role = F.when(F.col(row) < F.col("recon"), body).when(F.col(row) <= F.col("stack"), "reconciliation").when(F.col("_total"), "section_total").when(header, "section_header").otherwise("annex_duplicate")
    return book.join(publish, file, "left").select(file, row, role.alias("wb_role"), "recon")


def classify_rows(rows: DataFrame, file: str = "_source_file", row: str = "_row_num", least_rows: int = 2) -> DataFrame:
    """``rows`` with ``row_role``, and ``is_redacted`` also set on annex copies of redacted body rows.

    A file's last row is its total if it equals the sum of all others to the penny and isn't zero, in files of at least
    ``least_rows`` rows; an unnamed last row repeating the nearest named amount above it is a leftover.  A workbook role
    goes first.  (file, row) must be unique; rows without amounts count as nothing in sums.
    """
    book = workbook_roles(rows, file, row)
    roles = book.select(file, row, "wb_role")
    annex = rows.join(book.where("wb_role = 'annex_duplicate'").select(file, row), [file, row]).where("NOT coalesce(is_redacted, false)").select(file, row, "amount", F.col("expense_type_raw"))
    hidden = rows.join(book.select(file, row, "recon"), [file, row]).where((F.col(row) < F.col("recon")) & F.col("is_redacted")).select(file, "amount", "expense_type_raw").distinct()
    inherits = annex.join(hidden, [file, "amount", "expense_type_raw"]).select(file, row).distinct().withColumn("_inherits", F.lit(True))
    unnamed = F.coalesce(F.trim("supplier_name_raw"), F.lit("")) == ""
    # the nearest named amount matters for an unnamed last row only, and is then simply the file's last
    above = F.max_by("amount", F.when(~unnamed & F.col("amount").isNotNull(), F.col(row)))
    facts = rows.groupBy(file).agg(F.sum("amount").cast("decimal(38,2)").alias("_sum"), F.max(row).alias("_last"), F.count(F.lit(1)).alias("_rows"), above.alias("_named_above"))
    j = checked_join(rows, facts, [file]).join(roles, [file, row], "left").join(inherits, [file, row], "left")
    last = F.col(row) == F.col("_last")
    amount = F.col("amount")
    role = (
        F.when(F.col("wb_role").isNotNull(), F.col("wb_role"))
        .when(last & (F.col("_rows") >= least_rows) & (amount != 0) & ((amount + amount).cast("decimal(38,2)") == F.col("_sum")), "file_total")
        .when(last & unnamed & ~F.coalesce("is_redacted", F.lit(False)) & (amount == F.col("_named_above")), "trailing_artefact")
        .otherwise("transaction")
    )
    out = [F.coalesce(F.col("is_redacted") | F.col("_inherits"), F.col("is_redacted"), F.col("_inherits"), F.lit(False)).alias(c) if c == "is_redacted" else F.col(c) for c in rows.columns]
    return j.select(*out, role.alias("row_role"))
