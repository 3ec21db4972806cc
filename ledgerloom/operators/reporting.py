"""Dimensions, facts and their narrow export forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.columns import mask_individual, names_individual, surrogate_key
from ledgerloom.operators.golden import supplier_key
from ledgerloom.operators.skew import checked_join

WINDOW_FROM, WINDOW_TO = "2024-03-01", "2025-02-28"
UNCATEGORISED = "UNCATEGORISED"


def dim_supplier(golden: DataFrame, matches: DataFrame) -> DataFrame:
    """Suppliers with the tier and confidence of their strongest evidence, a state, and what their resolution rests on."""
    key = supplier_key(F.col("is_resolved"), F.col("matched_company_number"), F.col("supplier_name_norm")).alias("supplier_key")
    reviewed = F.col("match_confidence") == "reviewed"
    tier = matches.select(key, "match_tier", "match_confidence", (F.col("is_resolved") & ~reviewed).alias("_m"), (F.col("is_resolved") & reviewed & F.coalesce(F.col("review_decided_by") == "user", F.lit(False))).alias("_u")).groupBy("supplier_key").agg(
        F.min("match_tier").alias("match_tier"), F.min_by("match_confidence", F.struct("match_tier", "match_confidence")).alias("match_confidence"), F.bool_or("_m").alias("_m"), F.bool_or("_u").alias("_u"))
    reason = F.col("unresolved_reason")
    return golden.join(tier, "supplier_key", "left").select(
        "supplier_key", "company_number", F.col("display_name").alias("supplier_name"), "legal_name", "company_status", "incorporation_date", "postcode", "name_variant_count", "is_resolved", "unresolved_reason", "match_tier", "match_confidence",
        F.when(F.col("is_resolved"), "Resolved").when(reason == "review", "Awaiting review").when(reason == "redacted", "Redacted at source").otherwise("Unresolved").alias("resolution_state"),
        F.when(~F.col("is_resolved"), "unresolved").when(F.col("_m"), "method").when(F.col("_u"), "user_review").otherwise("delegated_review").alias("resolution_basis"))


def dim_entity(resolved: DataFrame) -> DataFrame:
    """Each publisher's rows, value, suppliers, span and files."""
    return resolved.groupBy("entity").agg(
        F.min("publisher_type").alias("publisher_type"), F.count(F.lit(1)).alias("transaction_rows"), F.sum("amount").alias("transaction_value"), F.countDistinct("supplier_key").alias("distinct_suppliers"),
        F.min("payment_date").alias("first_payment"), F.max("payment_date").alias("last_payment"), F.countDistinct("_source_file").alias("source_files"))


def dim_date(resolved: DataFrame, start: str = WINDOW_FROM, end: str = WINDOW_TO) -> DataFrame:
    """Every day of the observed span without gaps, with calendar and April-to-March fiscal parts; the analysis window is a flag, not a filter."""
    days = resolved.agg(F.min("payment_date").alias("a"), F.max("payment_date").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("date_key"))
    d = F.col("date_key")
    fiscal = F.when(F.month(d) >= 4, F.year(d)).otherwise(F.year(d) - 1)
    return days.select(
        d, F.year(d).alias("calendar_year"), F.quarter(d).alias("calendar_quarter"), F.month(d).alias("month_number"), F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "yyyy-MM").alias("year_month"), F.dayofmonth(d).alias("day_of_month"),
        F.date_format(d, "EEEE").alias("day_name"), F.dayofweek(d).isin(1, 7).alias("is_weekend"), fiscal.alias("fiscal_year"), F.concat(fiscal.cast("string"), F.lit("/"), F.lpad(((fiscal + 1) % 100).cast("string"), 2, "0")).alias("fiscal_year_label"),
        d.between(F.lit(start).cast("date"), F.lit(end).cast("date")).alias("is_in_analysis_window"))


def category_key():
    """Key of a line's category, UNCATEGORISED where it states none, so that the fact always finds its member."""
    blank = F.trim(F.coalesce("expense_type_raw", F.lit(""))) == ""
    return F.when(blank, UNCATEGORISED).otherwise(surrogate_key(F.col("entity"), F.col("expense_type_raw"), separator="||"))


def dim_category(resolved: DataFrame) -> DataFrame:
    """Each publisher's expense types, and one member for lines without any, present even if there are none."""
    keyed = resolved.withColumn("category_key", F.coalesce(category_key(), F.lit(UNCATEGORISED)))
    none = F.col("category_key") == UNCATEGORISED
    own = keyed.where(~none).groupBy("category_key", "entity", F.col("expense_type_raw").alias("expense_type")).agg(F.count(F.lit(1)).alias("transaction_rows"), F.sum("amount").alias("transaction_value"))
    own = own.select("category_key", "entity", "expense_type", F.concat_ws(" — ", "entity", "expense_type").alias("category_label"), F.lit(False).alias("is_uncategorised"), "transaction_rows", "transaction_value")
    rest = keyed.where(none).agg(F.count(F.lit(1)).alias("transaction_rows"), F.coalesce(F.sum("amount"), F.lit(0)).alias("transaction_value"))
    text = F.lit(None).cast("string")
    return own.unionByName(rest.select(F.lit(UNCATEGORISED).alias("category_key"), text.alias("entity"), text.alias("expense_type"), F.lit("Uncategorised").alias("category_label"), F.lit(True).alias("is_uncategorised"), "transaction_rows", F.col("transaction_value").cast("decimal(28,2)").alias("transaction_value")))


def facts(resolved: DataFrame, suppliers: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Payment lines of resolved and of unresolved suppliers, at the same grain."""
    keyed = resolved.where("supplier_key IS NOT NULL").withColumn("category_key", F.coalesce(category_key(), F.lit(UNCATEGORISED)))
    j = checked_join(keyed, suppliers.select("supplier_key", "is_resolved", "unresolved_reason"), ["supplier_key"])
    common = ["spend_id", "supplier_key", "entity", F.col("payment_date").alias("date_key"), "category_key", "amount", "transaction_number", "_source_file"]
    reviewed = F.col("match_confidence") == "reviewed"
    basis = F.when(reviewed & F.coalesce(F.col("review_decided_by") == "user", F.lit(False)), "user_review").when(reviewed, "delegated_review").otherwise("method")
    done = checked_join(j.where("is_resolved"), matches.select("supplier_name_norm", "match_confidence", "review_decided_by"), ["supplier_name_norm"]).select(*common, basis.alias("resolution_basis"))
    return done, j.where("NOT is_resolved").select(*common, "unresolved_reason")


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with dense ids from 1 in the order of ``key``.

    Rows are range-partitioned and sorted by key, counted per partition, and numbered within partitions on top of the
    counts before, so no single task sorts the whole table.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, F.col(key).asc_nulls_first()).withColumn("_p", F.spark_partition_id())
    placed = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(F.col(key).asc_nulls_first())))
    sizes = placed.groupBy("_p").agg(F.max("_k").alias("_n"))
    # at most one row per partition
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_before")
    return placed.join(F.broadcast(starts), "_p").withColumn(name, (F.col("_k") + F.col("_before")).cast("bigint")).select(name, *df.columns)


def export_supplier(suppliers: DataFrame) -> DataFrame:
    """Suppliers with integer ids, without postcode, unresolved individuals' names withheld."""
    masked = suppliers.drop("postcode").withColumn("is_individual_withheld", ~F.col("is_resolved") & names_individual(F.col("supplier_name"))).withColumn("supplier_name", mask_individual(F.col("supplier_name"), F.col("is_resolved")))
    return numbered(masked, "supplier_key", "supplier_id")


def export_fact(fact: DataFrame, suppliers: DataFrame, entities: DataFrame, categories: DataFrame, files: DataFrame) -> DataFrame:
    """A fact with integer ids only and a 16-figure reference; every side is joined on its unique key, broadcast only within a counted bound."""
    f = fact
    for dim, key, ident in ((suppliers, "supplier_key", "supplier_id"), (entities, "entity", "entity_id"), (categories, "category_key", "category_id"), (files, "_source_file", "source_file_id")):
        f = checked_join(f, dim.select(key, ident), [key])
    last = "resolution_basis" if "resolution_basis" in fact.columns else "unresolved_reason"
    return f.select(F.substring("spend_id", 1, 16).alias("spend_ref"), "supplier_id", "entity_id", "date_key", "category_id", "source_file_id", "amount", "transaction_number", last)
