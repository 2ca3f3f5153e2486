"""Joins on a key that a few values may dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than 1/HOT_SHARE of the rows is hot: there are under HOT_SHARE
#: such keys whatever the data, which bounds the broadcast.
HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``groups``, which has one row per ``key`` and
    in ``size`` the number of rows of that key.

    Rows of hot keys take their group from a broadcast of under ``HOT_SHARE`` rows;
    all others meet theirs in a sort-merge join, where no key exceeds that share.
    """
    added = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total)).withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), key, "left")
    of_hot = tagged.where(F.col("_hot")).select(*rows.columns, *added)
    others = tagged.where(F.col("_hot").isNull()).select(*rows.columns)
    return of_hot.unionByName(others.join(groups.hint("merge"), key, how).select(*rows.columns, *added))


def join_once(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: list[str]) -> DataFrame:
    """As ``join_groups`` with a left join, for rows that are dear to work out twice: all
    go through one sort-merge join, where rows of hot keys, which have their group from
    the broadcast, are spread by the columns ``spread`` and meet nothing."""
    added = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total)).select(key, F.struct(*added).alias("_hot"))
    salt = F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(*spread), F.lit(HOT_SHARE)))
    tagged = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", salt)
    others = groups.select(key, F.lit(0).cast("long").alias("_salt"), F.struct(*added).alias("_met"))
    met = tagged.join(others.hint("merge"), [key, "_salt"], "left")
    return met.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_met.{c}")).alias(c) for c in added])
