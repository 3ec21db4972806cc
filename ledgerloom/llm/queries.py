"""Queries of the llm operators over the tables of a data folder, and their SQL where it can be written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import leakage, matching, residue, survivor, tokenizing, variants
from ledgerloom.plans.tables import table


def p2_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Which company each unresolved payee name was, with the confidence."""
    return matching.company_matches(table(spark, folder, "staging_spend"), table(spark, folder, "resolved_spend"), table(spark, folder, "staging_companies"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The matches of ``p2_matches`` without their confidence."""
    return p2_matches(spark, folder).select("supplier_name_norm", "company_number")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving name and postcode of each supplier with several records."""
    return survivor.best_records(table(spark, folder, "resolved_supplier_golden"))


def p5_consensus(spark: SparkSession, folder: str) -> DataFrame:
    """The token consensus of each supplier's spellings and the spelling closest to it."""
    return survivor.consensus_names(table(spark, folder, "resolved_supplier_golden"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of spellings that mean the same firm or person."""
    return variants.variant_pairs(table(spark, folder, "staging_spend"), table(spark, folder, "staging_contracts"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return tokenizing.encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document that holds a passage of an evaluation item."""
    return leakage.leaked_items(table(spark, folder, "documents"), table(spark, folder, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that are or contain template residue, filler, error or refusal pages, or scripts-required notices."""
    return residue.residue_documents(table(spark, folder, "documents")).select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_matches": p2_matches, "p5_found": p5_found, "p5_consensus": p5_consensus, "p6_found": p6_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}
_WORDS = "string_split(trim(regexp_replace(lower(supplier_name_raw), '[^\\p{L}]+', ' ', 'g')), ' ')"
_STAND_IN = ", ".join(repr(w) for w in dict.fromkeys(survivor.STAND_IN_WORDS))
_CODE = "upper(regexp_replace(postcode, '[\\s\u00a0]', '', 'g'))"
ORACLES: dict[str, str] = {
    "p5_found": f"""WITH r AS (SELECT DISTINCT supplier_key, supplier_name_raw, rows_n, last_payment, postcode, entity, company_number FROM resolved_supplier_golden WHERE supplier_key IS NOT NULL),
  real AS (SELECT DISTINCT supplier_name_raw FROM (SELECT supplier_name_raw, unnest({_WORDS}) AS w FROM r) WHERE w <> '' AND w NOT IN ({_STAND_IN}) AND replace(w, w[1], '') <> ''),
  votes AS (SELECT supplier_key, supplier_name_raw, sum(coalesce(rows_n, 0)) AS v, max(last_payment) AS d FROM r JOIN real USING (supplier_name_raw) GROUP BY 1, 2),
  names AS (SELECT supplier_key, first(supplier_name_raw ORDER BY v DESC, d DESC NULLS LAST, supplier_name_raw) AS name FROM votes GROUP BY 1),
  codes AS (SELECT supplier_key, first(c ORDER BY d DESC NULLS LAST, n DESC, c) AS code FROM (SELECT supplier_key, left({_CODE}, -3) || ' ' || right({_CODE}, 3) AS c, last_payment AS d, coalesce(rows_n, 0) AS n FROM r WHERE regexp_full_match({_CODE}, '[A-Z]{{1,2}}[0-9][A-Z0-9]?[0-9][A-Z]{{2}}')) GROUP BY 1)
  SELECT supplier_key, name AS supplier_name_raw, coalesce(code, '') AS postcode FROM (SELECT supplier_key FROM r GROUP BY 1 HAVING count(*) > 1) LEFT JOIN names USING (supplier_key) LEFT JOIN codes USING (supplier_key)""",
}
