"""Percentiles by rank, from counts per value rather than from gathered values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def floor_percentile(df: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """Per group the element at floor(n * p) of the sorted values, counting from 0."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(below), "_all": F.sum("_n").over(Window.partitionBy(*by))})
    reached = F.col("_upto") > F.least(F.floor(F.col("_all") * F.lit(p)), F.col("_all") - 1)
    return ranked.where(reached).groupBy(*by).agg(F.min(value).alias(name))
