"""Queries from raw records to staged tables and over workbooks, each beside the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import row_roles, staging
from ledgerloom.plans.catalogue import CONFIRMED, PUBLISHERS, norm_sql, number_sql, query
from ledgerloom.plans.tables import table

# How the test publishers' files begin.
FILES_OF = {"department": "Department for Roads and Ports", "ministry": "Ministry of Tribunals", "revenue": "Revenue Collection Office", "alderwick": "Alderwick City Council", "netherhithe": "Netherhithe City Council", "tarnmoor": "Tarnmoor Borough Council"}


def _cell(*headings: str) -> str:
    """A cell by the first of the headings that a file has, in SQL."""
    at = "coalesce(" + ", ".join(f"nullif(list_position(keys, '{h}'), 0)" for h in headings) + ")"
    return f"(SELECT CASE WHEN x LIKE '\"%' THEN replace(x[2:-2], '\"\"', '\"') ELSE x END FROM (SELECT cells[{at}] AS x))"


def _cells(raw: str, columns: dict[str, tuple[str, ...]]) -> str:
    """The valid records of a raw table by the SQL of p4_found, with named cells."""
    from ledgerloom.plans.general import _FIELDS

    named = ", ".join(f"{_cell(*hs)} AS {c}" for c, hs in columns.items())
    return _FIELDS + f", c AS (SELECT source_file, row_num, {named} FROM v JOIN h USING (source_file) JOIN (SELECT DISTINCT source_file FROM {raw}) USING (source_file) WHERE (source_file, row_num) NOT IN (SELECT (source_file, row_num) FROM j WHERE reason IS NOT NULL))"


_DAY = "try_strptime(trim({0}), ['%d/%m/%Y', '%d-%b-%y', '%d-%b-%Y'])::DATE".format
_REGISTER = {"number": ("companynumber",), "name": ("companyname",), "status": ("companystatus",), "born": ("incorporationdate",), "postcode": ("regaddress.postcode",), "sic": ("siccode.sictext_1",)}


@query(_cells("raw_companies_house", _REGISTER) + f" SELECT {number_sql('number')} AS company_number, name AS company_name, {norm_sql('name')} AS company_name_norm, nullif(trim(status), '') AS company_status, {_DAY('born')} AS incorporation_date, nullif(trim(postcode), '') AS postcode, nullif(trim(sic), '') AS sic_code FROM c WHERE {number_sql('number')} IS NOT NULL")
def stage_companies(spark: SparkSession, folder: str) -> DataFrame:
    """The register's later delivery as a staged table."""
    return staging.stage_companies(table(spark, folder, "raw_companies_house"))


@query(f"""SELECT release_id, buyer_name, supplier_name_raw, {norm_sql('supplier_name_raw')} AS supplier_name_norm, CASE WHEN supplier_company_number IS NOT NULL AND length(release_id || supplier_name_raw) % 5 > 0 THEN supplier_company_number END AS supplier_company_number, NULL::DECIMAL(18,2) AS award_value, award_date, NULL::VARCHAR AS classification FROM staging_contracts""")
def stage_contracts(spark: SparkSession, folder: str) -> DataFrame:
    """Award lines from texts: numbers in capitals or not and with blanks, some under another scheme, releases with a time of day."""
    c = table(spark, folder, "staging_contracts")
    other = F.length(F.concat("release_id", "supplier_name_raw")) % 5 == 0
    raw = c.select(
        F.col("release_id").alias("ocid"), F.concat(F.lit(" "), "buyer_name", F.lit("  ")).alias("buyer"), F.col("supplier_name_raw").alias("supplier_name"), F.when(F.col("supplier_company_number").isNull(), "none").when(other, "other_scheme").otherwise("GB-COH").alias("category"),
        F.concat(F.lit(" "), F.lower("supplier_company_number")).alias("identifier"), F.concat(F.col("award_date").cast("string"), F.lit("T09:30:00Z")).alias("release_date"))
    return staging.stage_contracts(raw)


_LINES = _cells("raw_spend_lines", staging.SPEND_HEADINGS)
_BARE = "regexp_replace(amount_src, '[^0-9.\\-]', '', 'g')"
_STAGED = _LINES + f""", n AS (SELECT *, CASE WHEN regexp_full_match(trim(amount_src), '\\(.*\\)') THEN -1 ELSE 1 END * try_cast({_BARE} AS DECIMAL(38,2)) AS amount, trim(coalesce(supplier_name_raw, '')) <> '' AS named,
   coalesce(regexp_matches(upper(supplier_name_raw), 'REDACTED|REDACTION|PERSONAL INFORMATION|PERSONAL DATA|WITHHELD|NOT DISCLOSED|PRIVATE INDIVIDUAL|(^|[^A-Z0-9_])INDIVIDUAL([^A-Z0-9_]|$)|^PRIVATE$'), FALSE) AS is_redacted,
   CASE string_split(source_file, '_')[1] {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FILES_OF.items())} END AS entity FROM c),
 t AS (SELECT source_file, max(row_num) AS last, sum(amount) AS total, count(*) AS rows_n FROM n GROUP BY 1),
 s AS (SELECT *, last_value(CASE WHEN named THEN amount END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY row_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM n JOIN t USING (source_file))"""


@query(_STAGED + f""" SELECT sha256(source_file || '|' || row_num) AS spend_id, entity, CASE WHEN entity LIKE '%Council' THEN 'local' WHEN entity IS NOT NULL THEN 'central' END AS publisher_type, CASE WHEN entity IN ({', '.join(f"'{e}'" for e in CONFIRMED)}) THEN 'confirmed' ELSE 'code' END AS amount_vat_basis,
 {_DAY('payment_date_src')} AS payment_date, {_DAY('payment_date_src')} IS NULL AS is_undated, nullif(trim(expense_type_src), '') AS expense_type_raw, supplier_name_raw, {norm_sql('supplier_name_raw')} AS supplier_name_norm, supplier_postcode_src, amount, nullif(trim(transaction_number), '') AS transaction_number, is_redacted, source_file AS _source_file, row_num AS _row_num,
 CASE WHEN row_num = last AND rows_n >= 2 AND amount <> 0 AND amount + amount = total THEN 'file_total' WHEN row_num = last AND NOT named AND NOT is_redacted AND amount = above THEN 'trailing_artefact' ELSE 'transaction' END AS row_role FROM s""")
def stage_spend(spark: SparkSession, folder: str) -> DataFrame:
    """Spend files not yet staged as payment lines with what each row is."""
    s = staging.stage_spend(table(spark, folder, "raw_spend_lines"), FILES_OF, PUBLISHERS, CONFIRMED)
    return s.select("spend_id", "entity", "publisher_type", "amount_vat_basis", "payment_date", "is_undated", "expense_type_raw", "supplier_name_raw", "supplier_name_norm", "supplier_postcode_src", "amount", "transaction_number", "is_redacted", "_source_file", "_row_num", "row_role")


@query(_LINES + """ SELECT r.source_file, r.n AS raw_rows, coalesce(s.n, 0) AS staged_rows, coalesce(s.n, 0) AS found, 'PASS' AS verdict FROM (SELECT source_file, count(*) AS n FROM raw_spend_lines WHERE row_num > 0 GROUP BY 1) r LEFT JOIN (SELECT source_file, count(*) AS n FROM c GROUP BY 1) s USING (source_file)""")
def staged_rows_to_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Staged rows joined back to the raw records they came from."""
    raw = table(spark, folder, "raw_spend_lines")
    return staging.staged_to_raw(staging.stage_spend(raw, FILES_OF, PUBLISHERS, CONFIRMED), raw)


# Workbooks over the orders of the test tables: one file per order status, whose rows are numbered; each eleventh body row is an unnamed
# section total and each seventeenth an unnamed header; then a marker, section labels (the third is PUBLISH), a stack line and an annex that copies the body.
_BOOK = """WITH o AS (SELECT 'book_' || o_orderstatus AS f, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey, o_custkey, o_totalprice, o_orderpriority) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n, 'C' || o_custkey AS who, o_totalprice::DECIMAL(38,2) AS amt, o_orderpriority AS kind FROM (SELECT DISTINCT o_orderstatus, o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders)),
 body AS (SELECT f, rn AS r, CASE WHEN rn % 11 = 0 OR rn % 17 = 0 THEN NULL WHEN rn % 13 = 0 THEN 'REDACTED' ELSE who END AS who, CASE WHEN rn % 17 = 0 AND rn % 11 > 0 THEN NULL ELSE amt END AS amt, kind, rn % 13 = 0 AND rn % 11 > 0 AND rn % 17 > 0 AS red, n, who AS plain FROM o),
 m AS (SELECT DISTINCT f, n FROM body),
 book AS (SELECT f, r, who, amt, kind, red FROM body UNION ALL SELECT f, n + 1, 'Reconciliation to stack:', NULL, NULL, FALSE FROM m UNION ALL SELECT f, n + 1 + k, CASE k WHEN 3 THEN 'Publish' ELSE 'Section ' || k END, k::DECIMAL(38,2), NULL, FALSE FROM m, (SELECT unnest([1, 2, 3, 4]) AS k)
  UNION ALL SELECT f, n + 6, 'Final stack', 1, NULL, FALSE FROM m UNION ALL SELECT f, n + 6 + r, plain, amt, kind, FALSE FROM body WHERE amt IS NOT NULL),
 sec AS (SELECT b.*, n, count(*) FILTER (WHERE who IS NULL AND amt IS NOT NULL AND r <= n) OVER (PARTITION BY f ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM book b JOIN m USING (f)),
 roles AS (SELECT *, CASE WHEN r <= n THEN CASE WHEN who IS NULL AND amt IS NOT NULL THEN 'section_total' WHEN who IS NULL THEN 'section_header' WHEN s = 2 THEN 'transaction' ELSE 'out_of_scope_section' END WHEN r <= n + 6 THEN 'reconciliation' WHEN who IS NULL AND amt IS NOT NULL THEN 'section_total' WHEN who IS NULL THEN 'section_header' ELSE 'annex_duplicate' END AS role FROM sec)"""


def _workbook(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    c = F.col
    o = table(spark, folder, "orders").select("o_orderstatus", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").distinct()
    own = Window.partitionBy("o_orderstatus")
    o = o.select(F.concat(F.lit("book_"), "o_orderstatus").alias("f"), F.row_number().over(own.orderBy("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")).cast("bigint").alias("rn"), F.count(F.lit(1)).over(own).alias("n"), F.concat(F.lit("C"), c("o_custkey").cast("string")).alias("who"), c("o_totalprice").cast("decimal(38,2)").alias("amt"), c("o_orderpriority").alias("kind"))
    bare, header = (c("rn") % 11 == 0) | (c("rn") % 17 == 0), (c("rn") % 17 == 0) & (c("rn") % 11 > 0)
    hidden = ~bare & (c("rn") % 13 == 0)
    body = o.select("f", c("rn").alias("r"), F.when(bare, None).when(hidden, "REDACTED").otherwise(c("who")).alias("name"), F.when(~header, c("amt")).alias("amount"), "kind", hidden.alias("red"), "n", "who")
    m = body.select("f", "n").distinct()
    row = lambda df, r, name, amount: df.select("f", r.alias("r"), name.alias("name"), amount.cast("decimal(38,2)").alias("amount"), F.lit(None).cast("string").alias("kind"), F.lit(False).alias("red"))
    labels = m.withColumn("k", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3, 4)])))
    parts = [
        row(m, c("n") + 1, F.lit("Reconciliation to stack:"), F.lit(None)), row(labels, c("n") + 1 + c("k"), F.when(c("k") == 3, "Publish").otherwise(F.concat(F.lit("Section "), c("k").cast("string"))), c("k")), row(m, c("n") + 6, F.lit("Final stack"), F.lit(1)),
        body.where("amount IS NOT NULL").select("f", (c("n") + 6 + c("r")).alias("r"), c("who").alias("name"), "amount", "kind", F.lit(False).alias("red")),
    ]
    book = body.select("f", "r", "name", "amount", "kind", "red")
    for p in parts:
        book = book.unionByName(p)
    return book.select(c("f").alias("_source_file"), c("r").cast("bigint").alias("_row_num"), c("name").alias("supplier_name_raw"), "amount", c("kind").alias("expense_type_raw"), c("red").alias("is_redacted"))


@query(_BOOK + " SELECT f AS _source_file, r AS _row_num, role AS row_role FROM roles")
def row_role_workbook(spark: SparkSession, folder: str) -> DataFrame:
    """What each row of a workbook is: sections, reconciliation and annex."""
    return row_roles.classify_rows(_workbook(spark, folder)).select("_source_file", "_row_num", "row_role")


@query(_BOOK + " SELECT f AS _source_file, r AS _row_num, red OR (role = 'annex_duplicate' AND coalesce((f, amt, kind) IN (SELECT (f, amt, kind) FROM roles WHERE red AND r <= n), FALSE)) AS is_redacted FROM roles")
def redaction_propagation(spark: SparkSession, folder: str) -> DataFrame:
    """Annex copies of withheld body rows are withheld too."""
    return row_roles.classify_rows(_workbook(spark, folder)).select("_source_file", "_row_num", "is_redacted")
