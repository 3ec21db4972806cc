"""Set-similarity join by prefix filtering: lossless at its threshold, and far fewer pairs than any shared token would give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tokens(text) -> F.Column:
    """Distinct non-empty words of a text."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda t: t != ""))


def prefixes(sets: DataFrame, key: str, frequencies: DataFrame, threshold: float) -> DataFrame:
    """(key, tok, size): of each set the rarest |x| - ceil(threshold |x|) + 1 tokens, rarity as in ``frequencies`` (tok, n).

    A token unknown to ``frequencies`` is rarest of all; equal frequencies go by the token.  The order must be the same
    on both sides of a join, else pairs are lost.
    """
    long = sets.select(key, F.size("tokens").alias("size"), F.explode("tokens").alias("tok")).join(frequencies, "tok", "left")
    ranked = long.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("n", F.lit(0)), "tok")))
    keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size")).cast("int") + 1
    return ranked.where(F.col("_rank") <= keep).select(key, "tok", "size")


def prefix_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, threshold: float = 0.5) -> DataFrame:
    """(left_key, right_key, shared_tokens, left_tokens, right_tokens) of all pairs with Jaccard similarity of at least ``threshold``.

    Both sides have a unique key and an array column ``tokens`` without repetitions; frequencies are those of the right
    side.  Pairs meet on prefix tokens under the length bound, are made distinct, and only then are their sets compared, in
    integers.  NULL and empty sets match nothing.
    """
    frequencies = right.select(F.explode("tokens").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    a = prefixes(left, left_key, frequencies, threshold).withColumnRenamed("size", "_a")
    b = prefixes(right, right_key, frequencies, threshold).withColumnRenamed("size", "_b")
    t = F.lit(threshold)
    pairs = a.join(b, "tok").where((F.col("_b") >= t * F.col("_a")) & (F.col("_a") >= t * F.col("_b"))).select(left_key, right_key).distinct()
    full = pairs.join(left.select(left_key, F.col("tokens").alias("_ta")), left_key).join(right.select(right_key, F.col("tokens").alias("_tb")), right_key)
    sized = full.select(left_key, right_key, F.size(F.array_intersect("_ta", "_tb")).alias("shared_tokens"), F.size("_ta").alias("left_tokens"), F.size("_tb").alias("right_tokens"))
    union = F.col("left_tokens") + F.col("right_tokens") - F.col("shared_tokens")
    return sized.where(F.col("shared_tokens") >= t * union)
