"""Evidence for queued matches: previous names in force while payments were made, and awards of other buyers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.columns import name_core, normalise_name
from ledgerloom.operators.tiers import ACCEPT

#: Previous names a register record can hold; beyond them the oldest name's start is unknown.
MOST_NAMES = 10


def unpivot_names(register: DataFrame, number: str, names: list[str], days: list[str]) -> DataFrame:
    """(company_number, k, name, condate) from a register with numbered name and day columns; blank names and missing days are left out.

    Day columns may be dates or day-first text.
    """
    from ledgerloom.functions.columns import parse_date

    day = lambda c: F.col(f"`{c}`") if dict(register.dtypes)[c] == "date" else parse_date(F.col(f"`{c}`"))
    cells = F.array(*[F.struct(F.lit(k).alias("k"), F.trim(F.col(f"`{n}`")).alias("name"), day(d).alias("condate")) for k, (n, d) in enumerate(zip(names, days, strict=True), 1)])
    return register.select(F.trim(F.col(f"`{number}`")).alias("company_number"), F.inline(cells)).where("name <> '' AND condate IS NOT NULL")


def previous_name_windows(names: DataFrame, universe: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(company_number, k, prev_name, prev_core, valid_from, valid_to) of matchable companies.

    A name is valid until its condate, from the next older name's; the oldest known one from incorporation, unless the
    record is full and there may be older ones.  Repeated rows count once.
    """
    flat = names.where("name IS NOT NULL AND trim(name) <> '' AND condate IS NOT NULL").select("company_number", "k", F.trim("name").alias("prev_name"), "condate").distinct()
    older = flat.groupBy("company_number", (F.col("k") - 1).alias("k")).agg(F.max("condate").alias("_older"))
    born = universe.select("company_number", "incorporation_date")
    j = flat.join(older, ["company_number", "k"], "left").join(born, "company_number")
    return j.select("company_number", "k", "prev_name", name_core(normalise_name(F.col("prev_name"))).alias("prev_core"), F.coalesce("_older", F.when(F.col("k") < most, F.col("incorporation_date"))).alias("valid_from"), F.col("condate").alias("valid_to"))


def previous_name_evidence(spend: DataFrame, t4: DataFrame, t1: DataFrame, windows: DataFrame) -> DataFrame:
    """Candidates whose company once bore the payee's name during the whole span of its payments."""
    span = spend.where("supplier_name_norm IS NOT NULL").groupBy("supplier_name_norm").agg(
        F.min("payment_date").alias("first_payment"), F.max("payment_date").alias("last_payment"), F.array_join(F.sort_array(F.collect_set("entity")), "; ").alias("payers"))
    routes = t4.select("supplier_name_norm", F.col("candidate_company_number").alias("company_number"), F.lit("tier 4").alias("route")).unionByName(
        t1.where("candidate_company_number IS NOT NULL").select("supplier_name_norm", F.col("candidate_company_number").alias("company_number"), F.lit("tier 1").alias("route"))).distinct()
    offered = routes.groupBy("supplier_name_norm", "company_number").agg(F.array_join(F.sort_array(F.collect_set("route")), " + ").alias("candidate_route")).withColumn("prev_core", name_core(F.col("supplier_name_norm")))
    j = offered.join(windows, ["company_number", "prev_core"]).join(span, "supplier_name_norm").where("valid_from IS NOT NULL AND first_payment >= valid_from AND last_payment < valid_to")
    first = F.min(F.struct("valid_to", "valid_from", "prev_name")).alias("_p")
    return j.groupBy("supplier_name_norm", "company_number", "candidate_route", "first_payment", "last_payment", "payers").agg(first).select(
        "supplier_name_norm", "company_number", "candidate_route", F.col("_p.prev_name").alias("prev_name"), F.col("_p.valid_from").alias("valid_from"), F.col("_p.valid_to").alias("valid_to"), "first_payment", "last_payment", "payers")


def other_buyer_evidence(t4: DataFrame, contracts: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Awards under a candidate's core, for its company and for others; it qualifies if all that state a number state this one."""
    offered = t4.where(F.col("match_score") >= accept).select("supplier_name_norm", F.col("candidate_company_number").alias("company_number"), "candidate_count", name_core(F.col("supplier_name_norm")).alias("core"))
    awards = contracts.where("supplier_company_number IS NOT NULL").select(name_core(F.col("supplier_name_norm")).alias("core"), "supplier_company_number", "buyer_name", "award_date")
    own = F.col("supplier_company_number") == F.col("company_number")
    listed = lambda c, p: F.array_join(F.sort_array(F.collect_set(F.when(p, F.col(c)))), "; ")
    out = offered.join(awards, "core").groupBy("supplier_name_norm", "company_number", "candidate_count").agg(
        F.count_if(own).alias("awards_for"), F.count_if(~own).alias("awards_other"), listed("buyer_name", own).alias("buyers_for"), listed("supplier_company_number", ~own).alias("other_numbers"),
        F.min(F.when(own, F.col("award_date"))).alias("first_award"), F.max(F.when(own, F.col("award_date"))).alias("last_award"))
    return out.withColumn("qualifies", (F.col("awards_for") > 0) & (F.col("awards_other") == 0) & (F.col("candidate_count") == 1))


def decisions_in_force(own: DataFrame, delegated: DataFrame) -> DataFrame:
    """Recorded decisions with those of the first table overriding the second's; an evidence class not stated is read from the note."""
    stated = F.nullif(F.regexp_extract("decision_note", r"((?:ACCEPT|REJECT)-[A-Z-]+) \(the", 1), F.lit(""))
    first = own.withColumn("evidence_class", F.coalesce(stated, F.lit("user_review")))
    return first.unionByName(delegated.join(own.select("supplier_name_norm").distinct(), "supplier_name_norm", "left_anti").select(*first.columns))
