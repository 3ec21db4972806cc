"""Queries of the general data operators (problems 1, 3, 4 and 7) over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import asof, drift, record_parsing, timestamps
from ledgerloom.plans.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The UTC moment of each payment line that states a time."""
    lines = table(spark, folder, "staging_spend").select("spend_id", "payment_date_src", "entity", "_retrieved_at")
    return timestamps.normalise_moments(lines, "payment_date_src", ["entity"], "_retrieved_at").where("utc_micros IS NOT NULL").select("spend_id", "utc_micros")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each change of the two drifting fields between neighbouring files of a unit."""
    rows = table(spark, folder, "staging_spend").select("_source_file", *drift.FIELD_HEADINGS)
    return drift.drift_report(table(spark, folder, "raw_spend_headers"), rows).select("source_file", "field", "change")


def p3_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All payment lines in one typed table with the heading that fed each drifting field."""
    rows = table(spark, folder, "staging_spend").select("spend_id", "_source_file", *drift.FIELD_HEADINGS)
    typed, _ = drift.unify(rows, {"expense_type_src": "bigint"}, "_source_file")
    return drift.unified_table(table(spark, folder, "raw_spend_headers"), typed)


def p3_failed_casts(spark: SparkSession, folder: str) -> DataFrame:
    """Values of the drifting fields that don't cast to a number, per file."""
    rows = table(spark, folder, "staging_spend").select("_source_file", *drift.FIELD_HEADINGS)
    return drift.unify(rows, {f: "bigint" for f in drift.FIELD_HEADINGS}, "_source_file")[1]


def p4_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records of both deliveries after their headers, with fields or a reason."""
    register = table(spark, folder, "raw_companies_house").select("source_file", "row_num", "raw_record")
    return record_parsing.classify_records(register.unionByName(table(spark, folder, "raw_spend_lines").select("source_file", "row_num", "raw_record")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The records that don't parse, with the reason."""
    return p4_records(spark, folder).where("reason IS NOT NULL").select("source_file", "row_num", "reason")


def p4_faults(spark: SparkSession, folder: str) -> DataFrame:
    """The records with misplaced quotation marks and the byte offset of the first."""
    return p4_records(spark, folder).where("fault_at IS NOT NULL").select("source_file", "row_num", "fault_at")


def p4_valid(spark: SparkSession, folder: str) -> DataFrame:
    """The valid records, their checked columns typed, with all fields."""
    return record_parsing.typed_records(p4_records(spark, folder)).select("source_file", "row_num", "company_number", "day", "amount", F.to_json("fields").alias("fields"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The previous name in force and known on the day of each resolved payment."""
    return asof.names_as_known(table(spark, folder, "staging_spend"), table(spark, folder, "resolved_spend"), table(spark, folder, "resolved_company_previous_names"), table(spark, folder, "staging_companies"))


_SQUEEZED = "lower(regexp_replace(header_text, '[\\s\ufeff\u00a0\u200b]', '', 'g'))"
_FIELD = "CASE " + " ".join(f"WHEN {_SQUEEZED} IN ({', '.join(repr(k) for k in keys)}) THEN '{f}'" for f, keys in drift.FIELD_HEADINGS.items()) + " END"
_FIELDS = """WITH r AS (SELECT source_file, row_num, regexp_replace(raw_record, '\\r?\\n$', '') AS rec FROM raw_companies_house UNION ALL SELECT source_file, row_num, regexp_replace(raw_record, '\\r?\\n$', '') FROM raw_spend_lines),
  h AS (SELECT source_file, string_split(lower(regexp_replace(min(rec), '[\\s\u00a0\ufeff]', '', 'g')), ',') AS keys FROM r WHERE row_num = 0 GROUP BY 1),
  i AS (SELECT source_file, len(keys) AS width, coalesce(list_position(keys, 'companynumber'), 0) AS n, coalesce(nullif(list_position(keys, 'incorporationdate'), 0), nullif(list_position(keys, 'paymentdate'), 0), nullif(list_position(keys, 'date'), 0), nullif(list_position(keys, 'datepaid'), 0), 0) AS d,
    coalesce(nullif(list_position(keys, 'amount'), 0), nullif(list_position(keys, 'netamount'), 0), nullif(list_position(keys, '£'), 0), 0) AS a FROM h),
  f AS (SELECT source_file, row_num, regexp_full_match(rec, '(?s)("([^"]|"")*"|[^",]*)(,("([^"]|"")*"|[^",]*))*') AS fits, regexp_extract_all(',' || rec, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) AS cells FROM r WHERE row_num > 0),
  v AS (SELECT *, trim(trim(cells[n], '"')) AS num, trim(trim(cells[d], '"')) AS day, regexp_replace(trim(cells[a], '"'), '[\\s,£]', '', 'g') AS amt FROM f LEFT JOIN i USING (source_file)),
  j AS (SELECT source_file, row_num, CASE WHEN NOT fits THEN 'quoting' WHEN len(cells) <> width THEN 'column_count'
    WHEN (n > 0 AND NOT coalesce((regexp_full_match(num, '[0-9]{1,8}') AND NOT regexp_full_match(num, '0+')) OR regexp_full_match(upper(num), '[A-Z]{2}[0-9]{1,6}'), FALSE)) OR (d > 0 AND try_strptime(day, ['%d/%m/%Y', '%d-%b-%y', '%d-%b-%Y']) IS NULL)
      OR (a > 0 AND NOT coalesce(regexp_full_match(amt, '-?\\d+(\\.\\d*)?|\\(-?\\d+(\\.\\d*)?\\)'), FALSE)) THEN 'bad_value' END AS reason FROM v)"""
_UNQUOTED = "list_transform(cells, lambda x: CASE WHEN x LIKE '\"%' THEN replace(x[2:-2], '\"\"', '\"') ELSE x END)"
ORACLES = {
    "p4_valid": _FIELDS + f""" SELECT source_file, row_num, CASE WHEN n > 0 THEN CASE WHEN regexp_full_match(trim(num), '[0-9]+') THEN lpad(ltrim(trim(num), '0'), 8, '0') ELSE upper(trim(num))[1:2] || lpad(ltrim(trim(num)[3:], '0'), 6, '0') END END AS company_number,
   CASE WHEN d > 0 THEN try_strptime(day, ['%d/%m/%Y', '%d-%b-%y', '%d-%b-%Y'])::DATE END AS day, CASE WHEN a > 0 THEN (CASE WHEN amt LIKE '(%' OR amt LIKE '%-%' THEN -1 ELSE 1 END * regexp_replace(amt, '[()-]', '', 'g')::DECIMAL(18,2))::DECIMAL(18,2) END AS amount, to_json({_UNQUOTED})::VARCHAR AS fields
  FROM v SEMI JOIN (SELECT source_file, row_num FROM j WHERE reason IS NULL) USING (source_file, row_num)""",
    "p4_found": _FIELDS + " SELECT source_file, row_num, reason FROM j WHERE reason IS NOT NULL",
    "p3_found": f"""WITH cols AS (SELECT source_file, unit_code, period, {_FIELD} AS field, {_SQUEEZED} AS heading FROM raw_spend_headers),
  files AS (SELECT DISTINCT source_file, unit_code, period FROM raw_spend_headers), fields AS (SELECT unnest(['expense_type_src', 'supplier_postcode_src']) AS field),
  vals AS (SELECT _source_file AS source_file, 'expense_type_src' AS field, expense_type_src AS v FROM staging_spend UNION ALL SELECT _source_file, 'supplier_postcode_src', supplier_postcode_src FROM staging_spend),
  kinds AS (SELECT source_file, field, count(*) FILTER (WHERE regexp_full_match(v, '\\s*[+-]?\\d+(\\.\\d+)?\\s*')) * 2 > count(*) AS num FROM vals WHERE trim(v) <> '' GROUP BY 1, 2),
  f AS (SELECT files.source_file, unit_code, period, fields.field, (SELECT min(heading) FROM cols c WHERE c.source_file = files.source_file AND c.field = fields.field) AS h, num FROM files, fields LEFT JOIN kinds ON kinds.source_file = files.source_file AND kinds.field = fields.field),
  p AS (SELECT *, lag(h) OVER w AS h0, lag(num) OVER w AS num0, row_number() OVER w AS rn FROM f WINDOW w AS (PARTITION BY unit_code, field ORDER BY period, source_file))
  SELECT source_file, field, 'added' AS change FROM p WHERE rn > 1 AND h IS NOT NULL AND h0 IS NULL UNION ALL SELECT source_file, field, 'removed' FROM p WHERE rn > 1 AND h IS NULL AND h0 IS NOT NULL
  UNION ALL SELECT source_file, field, 'renamed' FROM p WHERE rn > 1 AND h <> h0 UNION ALL SELECT source_file, field, 'retyped' FROM p WHERE rn > 1 AND h IS NOT NULL AND h0 IS NOT NULL AND num <> num0""",
    "p7_found": """WITH v AS (SELECT company_number, greatest(condate, coalesce(recorded_on, condate)) AS ends, first(name ORDER BY k DESC, name) AS name FROM resolved_company_previous_names WHERE condate IS NOT NULL AND name IS NOT NULL GROUP BY 1, 2)
  SELECT DISTINCT s.spend_id, (SELECT first(v.name ORDER BY v.ends) FROM v WHERE v.company_number = r.company_number AND v.ends > s.payment_date) AS name FROM staging_spend s JOIN resolved_spend r USING (spend_id) LEFT JOIN staging_companies c ON c.company_number = r.company_number
  WHERE NOT coalesce(s.payment_date < c.incorporation_date, FALSE) AND EXISTS (SELECT 1 FROM v WHERE v.company_number = r.company_number AND v.ends > s.payment_date)""",
    "p3_unified": f"""SELECT s.spend_id, s._source_file, s.expense_type_src, s.supplier_postcode_src, try_cast(nullif(trim(s.expense_type_src), '') AS BIGINT) AS expense_type_src_typed, h.e AS expense_type_src_heading, h.p AS supplier_postcode_src_heading FROM staging_spend s LEFT JOIN (
    SELECT source_file, arg_min(header_text, col_pos) FILTER (WHERE {_FIELD} = 'expense_type_src') AS e, arg_min(header_text, col_pos) FILTER (WHERE {_FIELD} = 'supplier_postcode_src') AS p FROM raw_spend_headers GROUP BY 1) h ON h.source_file = s._source_file""",
    "p3_failed_casts": """SELECT _source_file AS file, field AS column, 'bigint' AS type, count(*) AS failed, min(v) AS example FROM (SELECT _source_file, 'expense_type_src' AS field, expense_type_src AS v FROM staging_spend UNION ALL SELECT _source_file, 'supplier_postcode_src', supplier_postcode_src FROM staging_spend) WHERE trim(v) <> '' AND NOT regexp_full_match(trim(v), '[+-]?\\d+') GROUP BY 1, 2""",
}
QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_unified": p3_unified, "p3_failed_casts": p3_failed_casts, "p4_found": p4_found, "p4_faults": p4_faults, "p4_valid": p4_valid, "p7_found": p7_found}
