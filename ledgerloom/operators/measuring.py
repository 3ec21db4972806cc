"""The matcher measured against awards that state the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLDS = tuple(round(0.5 + 0.05 * k, 2) for k in range(11))


def _predicted(contracts: DataFrame, t2: DataFrame, t4: DataFrame) -> DataFrame:
    population = contracts.where("supplier_company_number IS NOT NULL AND supplier_name_norm IS NOT NULL").select("supplier_name_norm", F.col("supplier_company_number").alias("truth"))
    exact = t2.where("accepted").select("supplier_name_norm", F.col("candidate_company_number").alias("exact"))
    return population.join(exact, "supplier_name_norm", "left").join(t4.select("supplier_name_norm", F.col("candidate_company_number").alias("similar"), "match_score"), "supplier_name_norm", "left")


def _pct(part, whole):
    return F.round(F.try_divide(F.lit(100.0) * part, whole), 2)


def precision_curve(contracts: DataFrame, t2: DataFrame, t4: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold of tier 4: matches made and correct, precision, coverage (made of all) and recall (correct of all)."""
    marks = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    j = _predicted(contracts, t2, t4).select("*", marks)
    similar = F.col("exact").isNull() & F.coalesce(F.col("match_score") >= F.col("threshold"), F.lit(False))
    j = j.withColumn("_t4", similar).withColumn("guess", F.coalesce("exact", F.when(similar, F.col("similar"))))
    made, right = F.col("guess").isNotNull(), F.coalesce(F.col("guess") == F.col("truth"), F.lit(False))
    out = j.groupBy("threshold").agg(F.count(F.lit(1)).alias("population_awards"), F.count_if(made).alias("matches_made"), F.count_if(right).alias("correct"), F.count_if("_t4").alias("tier4_matches"), F.count_if(F.col("_t4") & right).alias("tier4_correct"))
    return out.select("*", _pct(F.col("correct"), F.col("matches_made")).alias("precision_pct"), _pct(F.col("matches_made"), F.col("population_awards")).alias("coverage_pct"), _pct(F.col("correct"), F.col("population_awards")).alias("recall_pct"))


def precision_per_tier(contracts: DataFrame, t2: DataFrame, t4: DataFrame, accept: float = 0.85) -> DataFrame:
    """Awards, matches, correct and wrong ones per tier, and for all tiers together in one rollup."""
    similar = F.col("exact").isNull() & F.coalesce(F.col("match_score") >= accept, F.lit(False))
    j = _predicted(contracts, t2, t4).select(F.when(F.col("exact").isNotNull(), "2 exact name").when(similar, "4 similar name").otherwise("5 no match").alias("tier"), F.coalesce("exact", F.when(similar, F.col("similar"))).alias("guess"), "truth")
    made, right = F.col("guess").isNotNull(), F.coalesce(F.col("guess") == F.col("truth"), F.lit(False))
    out = j.rollup("tier").agg(F.count(F.lit(1)).alias("awards"), F.count_if(made).alias("matches_made"), F.count_if(right).alias("correct"), F.count_if(made & ~right).alias("wrong"))
    return out.select(F.coalesce("tier", F.lit("ALL TIERS")).alias("tier"), "awards", "matches_made", "correct", "wrong", _pct(F.col("correct"), F.col("matches_made")).alias("precision_pct"))
