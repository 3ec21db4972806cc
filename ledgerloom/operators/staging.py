"""Raw deliveries, record by record, to the staged tables: spend lines of all publishers, companies and award lines.

Records that don't parse stay behind (``record_parsing`` reports them).  Cells are found by their heading, whatever its letter
case, blanks and place; a column that a file lacks is a typed NULL.  Raw texts stay beside what was read from them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.operators.components import cut
from ledgerloom.operators.drift import heading_key
from ledgerloom.operators.record_parsing import classify_records, parse_records
from ledgerloom.operators.row_roles import classify_rows
from ledgerloom.operators.skew import checked_join

# Headings of spend files without blanks and in small letters, by the column that they feed.
SPEND_HEADINGS = {
    "payment_date_src": ("paymentdate", "date", "datepaid"), "expense_type_src": ("expensetype", "exptyp", "spendcategory", "costclassification", "natureofcost", "purposeofspending", "expenditureheading", "whatthemoneywasfor"),
    "expense_area_src": ("expensearea", "costarea", "servicearea"), "supplier_name_raw": ("supplier", "suppliername", "payee"), "supplier_postcode_src": ("supplierpostcode", "postcodeofpayee", "payeepostcode", "postalcode", "supppc", "locationcode", "vendoraddresscode"),
    "amount_src": ("amount", "netamount", "£"), "transaction_number": ("transactionno", "transactionnumber", "transref"), "description": ("description", "narrative", "itemtext", "detail"),
}


def valid_cells(raw: DataFrame, headings: Mapping[str, Sequence[str]], record: str = "raw_record", file: str = "source_file", row: str = "row_num") -> DataFrame:
    """(file, row, *headings): the cells of the records that parse, NULL where the file has no such column; the first listed heading that it has counts."""
    keys = F.transform("fields", lambda h: heading_key(h))
    heads = parse_records(raw.where(F.col(row) == 0).groupBy(file).agg(F.min(record).alias(record)), record).select(file, keys.alias("_keys"))
    rows = checked_join(classify_records(raw.select(file, row, record), record, file, row).where("reason IS NULL"), heads, [file])
    at = lambda hs: F.coalesce(*[F.nullif(F.array_position("_keys", h), F.lit(0)) for h in hs]).cast("int")
    return rows.select(file, row, *[F.try_element_at("fields", at(hs)).alias(c) for c, hs in headings.items()])


def stage_spend(raw: DataFrame, publishers: Mapping[str, str], kinds: Mapping[str, str], confirmed: Mapping[str, str], headings: Mapping[str, Sequence[str]] = SPEND_HEADINGS) -> DataFrame:
    """The payment lines of all publishers from records (source_file, row_num, raw_record), with what each row is.

    ``publishers`` maps the start of a file's name (before its first '_') to the publisher, which is set as a literal whatever
    the file says; ``kinds`` and ``confirmed`` classify publishers.  A row is padding, and left out, only if every cell is
    blank.  Totals and leftovers stay, told by ``row_role``; an unknown publisher has a NULL entity and kind.
    """
    c = F.col
    cells = valid_cells(raw, headings).where(C.non_blank_fields(*[c(h) for h in headings]) > 0)
    read = cells.select(
        C.surrogate_key(c("source_file"), c("row_num")).alias("spend_id"), C.classify(F.split_part("source_file", F.lit("_"), F.lit(1)), publishers).alias("entity"), "payment_date_src", C.parse_date(c("payment_date_src")).alias("payment_date"),
        C.blank_to_null(c("expense_type_src")).alias("expense_type_raw"), C.blank_to_null(c("expense_area_src")).alias("expense_area_raw"), "supplier_name_raw", C.normalise_name(c("supplier_name_raw")).alias("supplier_name_norm"), "supplier_postcode_src",
        "amount_src", C.parse_amount(c("amount_src")).cast("decimal(38,2)").alias("amount"), C.blank_to_null(c("transaction_number")).alias("transaction_number"), C.blank_to_null(c("description")).alias("description"), F.coalesce(C.is_redacted(c("supplier_name_raw")), F.lit(False)).alias("is_redacted"),
        c("source_file").alias("_source_file"), c("row_num").alias("_row_num"))
    judged = read.select("*", C.classify(c("entity"), kinds).alias("publisher_type"), C.classify(c("entity"), confirmed, "code").alias("amount_vat_basis"), c("payment_date").isNull().alias("is_undated"))
    # the roles are told by several passes over the rows, which are parsed once
    return classify_rows(cut(judged))


def stage_companies(raw: DataFrame) -> DataFrame:
    """The register from its records: one row per record with a number that can be brought to its canonical form, others are left out."""
    c = F.col
    headings = {"number": ("companynumber",), "name": ("companyname",), "status": ("companystatus",), "born": ("incorporationdate",), "postcode": ("regaddress.postcode",), "sic": ("siccode.sictext_1",)}
    cells = valid_cells(raw, headings)
    return cells.select(
        C.canon_company_number(c("number")).alias("company_number"), c("name").alias("company_name"), C.normalise_name(c("name")).alias("company_name_norm"), C.blank_to_null(c("status")).alias("company_status"),
        C.parse_date(F.trim("born")).alias("incorporation_date"), C.blank_to_null(c("postcode")).alias("postcode"), C.blank_to_null(c("sic")).alias("sic_code")).where("company_number IS NOT NULL")


def stage_contracts(raw: DataFrame, scheme: str = "GB-COH") -> DataFrame:
    """Award lines from (ocid, buyer, supplier_name, category, identifier, release_date), all text; a number counts only under ``scheme``.

    Value and classification, which the source lacks, are typed NULLs; the day is that of the release.  No row is dropped.
    """
    c = F.col
    return raw.select(
        c("ocid").alias("release_id"), C.blank_to_null(c("buyer")).alias("buyer_name"), c("supplier_name").alias("supplier_name_raw"), C.normalise_name(c("supplier_name")).alias("supplier_name_norm"),
        F.when(c("category") == scheme, C.canon_company_number(c("identifier"))).alias("supplier_company_number"), F.lit(None).cast("decimal(18,2)").alias("award_value"), F.try_to_timestamp("release_date").cast("date").alias("award_date"), F.lit(None).cast("string").alias("classification"))


def staged_to_raw(staged: DataFrame, raw: DataFrame) -> DataFrame:
    """Per file, staged rows joined back to the raw records by file and row: (source_file, raw_rows, staged_rows, found, verdict).

    Every staged row must be a record of its file, once.
    """
    a = staged.groupBy(F.col("_source_file").alias("source_file"), F.col("_row_num").alias("row_num")).agg(F.count(F.lit(1)).alias("s"))
    b = raw.where("row_num > 0").groupBy("source_file", "row_num").agg(F.count(F.lit(1)).alias("r"))
    per = a.join(b, ["source_file", "row_num"], "full").groupBy("source_file").agg(F.coalesce(F.sum("r"), F.lit(0)).alias("raw_rows"), F.coalesce(F.sum("s"), F.lit(0)).alias("staged_rows"), F.count_if((F.col("s") == 1) & (F.col("r") == 1)).alias("found"))
    return per.withColumn("verdict", F.when(F.col("staged_rows") == F.col("found"), "PASS").otherwise("FAIL"))
