"""Names matched to a company register in ordered tiers: a stated number, the exact name, name core and postcode, and token similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import clean_postcode, legal_suffix, name_core
from ledgerloom.operators.simjoin import prefix_join, tokens

#: Prefixes of numbers that are never matched, and of second registrations that give way to a namesake of another kind.
EXCLUDED, SECONDARY = "OE", "NF"
FLOOR, ACCEPT = 0.5, 0.85


def company_universe(companies: DataFrame, excluded: str = EXCLUDED, secondary: str = SECONDARY) -> DataFrame:
    """The companies that may be matched: none excluded by prefix, no secondary one whose name a primary company holds too."""
    kept = companies.where(~F.col("company_number").startswith(excluded))
    primary = kept.where(~F.col("company_number").startswith(secondary)).where("company_name_norm IS NOT NULL").select("company_name_norm").distinct()
    second = F.col("company_number").startswith(secondary)
    return kept.where(~second).unionByName(kept.where(second).join(primary, "company_name_norm", "left_anti").select(*kept.columns))


def name_universe(spend: DataFrame, contracts: DataFrame, postcode: str = "supplier_postcode_src") -> DataFrame:
    """One row per normalised name of unredacted lines or of awards that state a number, with its lines, value, first payment and postcodes."""
    lines = spend.where(~F.coalesce("is_redacted", F.lit(False)) & F.col("supplier_name_norm").isNotNull())
    paid = lines.groupBy("supplier_name_norm").agg(
        F.count(F.lit(1)).alias("spend_rows"), F.sum("amount").alias("spend_value"), F.min("payment_date").alias("first_payment_date"),
        F.sort_array(F.collect_set(clean_postcode(F.col(postcode)))).alias("spend_postcodes"), F.lit(True).alias("in_spend"))
    awarded = contracts.where("supplier_company_number IS NOT NULL AND supplier_name_norm IS NOT NULL").select("supplier_name_norm").distinct().withColumn("in_e3", F.lit(True))
    joined = paid.join(awarded, "supplier_name_norm", "full")
    return joined.select(
        "supplier_name_norm", name_core(F.col("supplier_name_norm")).alias("supplier_name_core"), F.coalesce("in_spend", F.lit(False)).alias("in_spend"), F.coalesce("in_e3", F.lit(False)).alias("in_e3"),
        "spend_rows", "spend_value", "first_payment_date", F.coalesce("spend_postcodes", F.array().cast("array<string>")).alias("spend_postcodes"))


def _early(paid: str = "first_payment_date", born: str = "incorporation_date") -> Column:
    """Whether the first payment precedes incorporation; unknown days speak against nothing."""
    return F.coalesce(F.col(paid) < F.col(born), F.lit(False))


def tier1(names: DataFrame, contracts: DataFrame, universe: DataFrame) -> DataFrame:
    """Numbers stated by awards to the same name: accepted if there is one, it is in the register under this very name, and no payment precedes it."""
    stated = contracts.where("supplier_company_number IS NOT NULL AND supplier_name_norm IS NOT NULL").groupBy("supplier_name_norm").agg(
        F.countDistinct("supplier_company_number").alias("candidate_count"), F.min("supplier_company_number").alias("_number"))
    keyed = names.where("in_spend").join(stated, "supplier_name_norm").withColumn("candidate_company_number", F.when(F.col("candidate_count") == 1, F.col("_number")))
    register = universe.select(F.col("company_number").alias("candidate_company_number"), F.lit(True).alias("_there"), F.col("company_name_norm").alias("register_name_norm"), "company_status", "incorporation_date")
    j = keyed.join(register, "candidate_company_number", "left").withColumn("in_register", F.coalesce("_there", F.lit(False)))
    agrees = F.coalesce(F.col("register_name_norm") == F.col("supplier_name_norm"), F.lit(False))
    sound = (F.col("candidate_count") == 1) & F.col("in_register") & ~_early()
    return j.select(
        "supplier_name_norm", "candidate_count", "candidate_company_number", "in_register", "register_name_norm", "company_status", "incorporation_date", agrees.alias("register_name_agrees"), (~_early()).alias("plausible"),
        F.when(F.col("candidate_count") > 1, "ambiguous").when(~F.col("in_register"), "number_not_in_register").when(_early(), "implausible_before_incorporation").when(~agrees, "register_name_disagrees").alias("reject_reason"),
        (sound & ~agrees).alias("demoted_to_review"), (sound & agrees).alias("accepted"))


def tier2(names: DataFrame, universe: DataFrame) -> DataFrame:
    """Exact names: accepted if one active company holds the name and no payment precedes it."""
    held = universe.where("company_name_norm IS NOT NULL").groupBy(F.col("company_name_norm").alias("supplier_name_norm")).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.count_if(F.col("company_status").startswith("Active")).alias("active_count"),
        F.min("company_number").alias("_n"), F.min("company_status").alias("_s"), F.min("incorporation_date").alias("_d"))
    one = F.col("candidate_count") == 1
    active = F.coalesce(F.col("_s").startswith("Active"), F.lit(False))
    j = names.join(held, "supplier_name_norm")
    return j.select(
        "supplier_name_norm", "in_spend", "in_e3", "candidate_count", "active_count", F.when(one, F.col("_n")).alias("candidate_company_number"), F.when(one, F.col("_s")).alias("company_status"), F.when(one, F.col("_d")).alias("incorporation_date"),
        F.when(~one, "ambiguous").when(~active, "single_candidate_not_active").when(_early(born="_d"), "implausible_before_incorporation").alias("reject_reason"), (one & active & ~_early(born="_d")).alias("accepted"))


def tier3(names: DataFrame, universe: DataFrame) -> DataFrame:
    """Name core and postcode: accepted if one company shares both and no payment precedes it."""
    register = universe.where("postcode IS NOT NULL AND company_name_norm IS NOT NULL").select(
        "company_number", "company_status", "incorporation_date", name_core(F.col("company_name_norm")).alias("supplier_name_core"), F.upper(F.regexp_replace("postcode", r"[ \t\n\f\r]", "")).alias("pc"))
    asked = names.where("in_spend AND supplier_name_core IS NOT NULL").select("supplier_name_norm", "supplier_name_core", "first_payment_date", F.explode("spend_postcodes").alias("pc"))
    found = asked.join(register, ["supplier_name_core", "pc"]).groupBy("supplier_name_norm").agg(
        F.countDistinct("company_number").alias("candidate_count"), F.min("company_number").alias("_n"), F.min("company_status").alias("_s"), F.min("incorporation_date").alias("_d"), F.min("first_payment_date").alias("first_payment_date"))
    one = F.col("candidate_count") == 1
    return found.select(
        "supplier_name_norm", "candidate_count", F.when(one, F.col("_n")).alias("candidate_company_number"), F.when(one, F.col("_s")).alias("company_status"), F.when(one, F.col("_d")).alias("incorporation_date"),
        F.when(~one, "ambiguous").when(_early(born="_d"), "implausible_before_incorporation").alias("reject_reason"), (one & ~_early(born="_d")).alias("accepted"))


def open_names(names: DataFrame, t2: DataFrame, t3: DataFrame) -> DataFrame:
    """Names with a core that neither tier 2 nor tier 3 accepted."""
    done = t2.where("accepted").select("supplier_name_norm").unionByName(t3.where("accepted").select("supplier_name_norm")).distinct()
    return names.where("supplier_name_core IS NOT NULL").join(done, "supplier_name_norm", "left_anti")


def tier4_candidates(names: DataFrame, t2: DataFrame, t3: DataFrame, universe: DataFrame, floor: float = FLOOR) -> DataFrame:
    """Companies whose core shares enough tokens with an open name's: same legal form where both state one, not incorporated after the first payment."""
    asked = open_names(names, t2, t3).withColumn("tokens", tokens(F.col("supplier_name_core")))
    register = universe.withColumn("core", name_core(F.col("company_name_norm"))).where("core IS NOT NULL").withColumn("tokens", tokens(F.col("core")))
    pairs = prefix_join(asked, register, "supplier_name_norm", "company_number", floor)
    j = pairs.join(asked.select("supplier_name_norm", "supplier_name_core", "in_spend", "in_e3", "first_payment_date"), "supplier_name_norm").join(
        register.select("company_number", "company_name", "company_name_norm", "company_status", "incorporation_date", "core"), "company_number")
    a, b = legal_suffix(F.col("supplier_name_norm")), legal_suffix(F.col("company_name_norm"))
    kept = j.where(~F.coalesce(a != b, F.lit(False)) & ~_early())
    longest = F.greatest(F.length("supplier_name_core"), F.length("core"))
    return kept.select(
        "supplier_name_norm", "in_spend", "in_e3", "company_number", "company_name", "company_status", "incorporation_date", "shared_tokens", F.col("left_tokens").alias("name_tokens"), F.col("right_tokens").alias("company_tokens"),
        (F.col("shared_tokens") / (F.col("left_tokens") + F.col("right_tokens") - F.col("shared_tokens"))).alias("score"), (1 - F.levenshtein("supplier_name_core", "core") / longest).alias("edit_similarity"))


def tier4_best(candidates: DataFrame) -> DataFrame:
    """The best candidate of each name (score, then edit similarity, then number), with how many companies tie at its score."""
    own = Window.partitionBy("supplier_name_norm")
    ranked = candidates.withColumn("_rank", F.row_number().over(own.orderBy(F.desc("score"), F.desc("edit_similarity"), "company_number"))).withColumn("_top", F.max("score").over(own))
    ranked = ranked.withColumn("candidate_count", F.count_if(F.col("score") == F.col("_top")).over(own)).where("_rank = 1")
    return ranked.select("supplier_name_norm", "in_spend", "in_e3", F.col("company_number").alias("candidate_company_number"), F.col("company_name").alias("candidate_company_name"), "company_status", "incorporation_date",
                         F.round("score", 4).alias("match_score"), F.round("edit_similarity", 4).alias("edit_similarity"), "candidate_count")


def blocking_reachability(names: DataFrame, t2: DataFrame, t3: DataFrame, universe: DataFrame, floor: float = FLOOR) -> DataFrame:
    """How many open names share no prefix token with any company: the ceiling that blocking sets on recall."""
    from ledgerloom.operators.simjoin import prefixes

    register = universe.select("company_number", tokens(name_core(F.col("company_name_norm"))).alias("tokens")).where("tokens IS NOT NULL")
    frequencies = register.select(F.explode("tokens").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    there = prefixes(register, "company_number", frequencies, floor).select("tok").distinct().withColumn("_hit", F.lit(1))
    asked = open_names(names, t2, t3).withColumn("tokens", tokens(F.col("supplier_name_core")))
    reach = prefixes(asked, "supplier_name_norm", frequencies, floor).join(there, "tok", "left").groupBy("supplier_name_norm").agg(F.count("_hit").alias("hits"))
    j = reach.join(asked.select("supplier_name_norm", "in_spend", "in_e3", "spend_value"), "supplier_name_norm")
    none = F.col("hits") == 0
    return j.agg(F.count(F.lit(1)).alias("names_in_population"), F.count_if(none).alias("unreachable_names"), F.count_if(none & F.col("in_spend")).alias("unreachable_spend_names"), F.count_if(none & F.col("in_e3")).alias("unreachable_e3_names"),
                 F.coalesce(F.sum(F.when(none, F.col("spend_value"))), F.lit(0)).cast("decimal(38,2)").alias("unreachable_spend_value"))
