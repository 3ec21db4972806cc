"""Controls that run after each layer and print their verdict beside the figures it rests on.

A check makes a one-row DataFrame (check_name, severity, expected, actual, verdict); ``run`` unions them.  Figures are
text, so that rows, money and names fit in one table.  Nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL = "PASS", "FAIL"


def _row(df: DataFrame, name: str, severity: str, expected: Column, actual: Column) -> DataFrame:
    good = F.coalesce(expected == actual, expected.isNull() & actual.isNull())
    return df.select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), expected.cast("string").alias("expected"), actual.cast("string").alias("actual"), F.when(good, PASS).otherwise(FAIL).alias("verdict"))


def row_count(df: DataFrame, expected: int, name: str = "row_count", severity: str = "HARD") -> DataFrame:
    return _row(df.agg(F.count(F.lit(1)).alias("n")), name, severity, F.lit(expected).cast("bigint"), F.col("n"))


def schema(df: DataFrame, columns: list[str], type_name: str | None = None, name: str = "schema", severity: str = "HARD") -> DataFrame:
    """Columns missing from ``df``, or of another type than ``type_name``, are none."""
    kinds = dict(df.dtypes)
    wrong = sum(c not in kinds or (type_name is not None and kinds[c] != type_name) for c in columns)
    return _row(df.sparkSession.range(1), name, severity, F.lit(0), F.lit(wrong))


def not_null(df: DataFrame, columns: list[str], name: str = "not_null", severity: str = "HARD") -> DataFrame:
    return _row(df.agg(F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])).alias("n")), name, severity, F.lit(0).cast("bigint"), F.col("n"))


def unique(df: DataFrame, columns: list[str], name: str = "unique", severity: str = "HARD") -> DataFrame:
    """Keys held by more than one row are none."""
    return _row(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("n")), name, severity, F.lit(0).cast("bigint"), F.col("n"))


def foreign_key(df: DataFrame, parent: DataFrame, column: str, name: str = "foreign_key", severity: str = "HARD") -> DataFrame:
    """Rows with a key that the parent lacks are none; NULL keys are not judged."""
    orphans = df.where(F.col(column).isNotNull()).join(parent.select(column).distinct(), column, "left_anti")
    return _row(orphans.agg(F.count(F.lit(1)).alias("n")), name, severity, F.lit(0).cast("bigint"), F.col("n"))


def conserved(before: DataFrame, after: DataFrame, amount: str = "amount", name: str = "conserved", severity: str = "HARD") -> DataFrame:
    """Rows and money are the same on both sides, to the penny."""
    total = lambda df, a: df.agg(F.concat_ws(" rows, ", F.count(F.lit(1)).cast("string"), F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(38,2)").cast("string")).alias(a))
    return _row(total(before, "a").crossJoin(total(after, "b")), name, severity, F.col("a"), F.col("b"))


def no_fan_out(fact: DataFrame, dimension: DataFrame, key: str, name: str = "no_fan_out", severity: str = "HARD") -> DataFrame:
    """Joining the dimension leaves the fact's row count as it is."""
    joined = fact.join(dimension.select(key), key, "left").agg(F.count(F.lit(1)).alias("b"))
    return _row(fact.agg(F.count(F.lit(1)).alias("a")).crossJoin(joined), name, severity, F.col("a"), F.col("b"))


def in_set(df: DataFrame, column: str, allowed: list[str], name: str = "in_set", severity: str = "HARD") -> DataFrame:
    """Values outside the allowed ones are none; NULL is outside."""
    return _row(df.agg(F.count_if(~F.coalesce(F.col(column).isin(allowed), F.lit(False))).alias("n")), name, severity, F.lit(0).cast("bigint"), F.col("n"))


def contiguous(df: DataFrame, group: str, row: str, name: str = "contiguous", severity: str = "SOFT") -> DataFrame:
    """Groups whose row numbers are not 1 to their count are none."""
    per = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("a"), F.max(row).alias("b"), F.countDistinct(row).alias("d"))
    return _row(per.agg(F.count_if((F.col("a") != 1) | (F.col("b") != F.col("n")) | (F.col("d") != F.col("n"))).alias("n")), name, severity, F.lit(0).cast("bigint"), F.col("n"))


def gapless(dates: DataFrame, column: str, name: str = "gapless", severity: str = "HARD") -> DataFrame:
    """The days of a dimension are as many as its span has."""
    a = dates.agg(F.count(F.lit(1)).alias("n"), (F.datediff(F.max(column), F.min(column)) + 1).cast("bigint").alias("span"))
    return _row(a, name, severity, F.col("span"), F.col("n"))


def reconciled(actual: DataFrame, expected: DataFrame, key: str, value: str, name: str = "reconciled", severity: str = "HARD") -> DataFrame:
    """Keys on one side only, or with another value, are none."""
    j = actual.select(key, F.col(value).alias("_a"), F.lit(1).alias("_x")).join(expected.select(key, F.col(value).alias("_e"), F.lit(1).alias("_y")), key, "full")
    return _row(j.agg(F.count_if(F.col("_x").isNull() | F.col("_y").isNull() | ~F.col("_a").eqNullSafe(F.col("_e"))).alias("n")), name, severity, F.lit(0).cast("bigint"), F.col("n"))


def invariant(df: DataFrame, broken: Column, name: str, severity: str = "HARD") -> DataFrame:
    """Rows that break a rule are none."""
    return _row(df.agg(F.count_if(F.coalesce(broken, F.lit(False))).alias("n")), name, severity, F.lit(0).cast("bigint"), F.col("n"))


def not_erased(df: DataFrame, raw: str, derived: str, name: str = "not_erased", severity: str = "SOFT") -> DataFrame:
    """Texts with letters or figures that the derived column lost altogether are none."""
    return invariant(df, F.col(raw).rlike("[A-Za-z0-9]") & F.col(derived).isNull(), name, severity)


def recompute(one: DataFrame, other: DataFrame, name: str = "recompute", severity: str = "HARD") -> DataFrame:
    """Two ways to the same table leave no row on one side only."""
    cols = sorted(one.columns)
    diff = one.select(*cols).exceptAll(other.select(*cols)).unionByName(other.select(*cols).exceptAll(one.select(*cols)))
    return _row(diff.agg(F.count(F.lit(1)).alias("n")), name, severity, F.lit(0).cast("bigint"), F.col("n"))


def run(checks: list[DataFrame]) -> DataFrame:
    """All checks in one table."""
    return reduce(DataFrame.unionByName, checks)
