"""Helpers that keep joins and groups balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast by ``checked_join``; the count is taken before the join is planned.
BROADCAST_ROWS = 50_000


def row_count_up_to(df: DataFrame, bound: int) -> int:
    """The rows of ``df``, or ``bound + 1`` if there are more; reads no more than it needs to decide."""
    return df.limit(bound + 1).count()


def checked_join(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner", bound: int = BROADCAST_ROWS, salts: int = 24) -> DataFrame:
    """Join ``left`` to a side that is usually small, without trusting that it is.

    The small side is counted up to ``bound``.  Within it, it is broadcast; beyond it, the rows of ``left`` are spread
    over ``salts`` copies of the small side, so that one hot key is shared by that many tasks.  ``how`` is ``inner``,
    ``left``, ``left_semi`` or ``left_anti``.  A NULL key matches nothing.  An empty side gives the usual join result.
    """
    if row_count_up_to(small, bound) <= bound:
        return left.join(F.broadcast(small), on, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int"))
    return keyed.join(salted, [*on, "_salt"], how).drop("_salt")


def hot_keys(df: DataFrame, key: str, share: int = 1000, least: int = 50_000) -> DataFrame:
    """Keys with more than ``max(least, rows / share)`` rows, as (key, rows, parts).

    At most ``share`` keys can qualify, so the result may be broadcast whatever the input's size; ``parts`` is the
    number of pieces that bring each key below the threshold.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    total = sizes.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("_n")).first()["_n"]
    limit = max(least, total // share)
    return sizes.where((F.col("_rows") > limit) & F.col(key).isNotNull()).withColumn("_parts", F.ceil(F.col("_rows") / F.lit(limit)).cast("int"))


def spread(value: Column, parts: int | Column) -> Column:
    """A stable part number in [0, parts) for ``value``."""
    return F.pmod(F.xxhash64(value), parts if isinstance(parts, Column) else F.lit(parts)).cast("int")


def fence(df: DataFrame, computed: list[str]) -> DataFrame:
    """``df`` with ``computed`` passed through a generator of one row.

    Later filters on these columns then run on their values; without it Catalyst would copy the whole chain of
    expressions behind each of them into the filter, once for every mention.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in computed]
    return df.select(*rest, F.inline(F.array(F.struct(*[F.col(c) for c in computed]))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)
