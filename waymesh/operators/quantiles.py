"""Exact quantiles of groups of any size.

Values are counted first; the running count is taken in two levels, so no task sees a whole group.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import with_running_sum


def exact_quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float], width: float) -> DataFrame:
    """Linear-interpolated quantiles per key; ``width`` is the stretch of values handled together."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    running = with_running_sum(counted, key, [value], F.col("_n"), "_upto", width)
    totals = counted.groupBy(key).agg(F.sum("_n").alias("_total"), F.max(value).alias("max_value"))
    joined = running.join(totals, key)

    def at(position):
        inside = (F.col("_upto") > position) & (F.col("_upto") - F.col("_n") <= position)
        return F.max(F.when(inside, F.col(value)))

    aggs = []
    for name, share in shares.items():
        rank = (F.col("_total") - 1) * share
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        weight = F.max(rank - F.floor(rank))
        aggs.append((low * (1 - weight) + high * weight).alias(name))
    return joined.groupBy(key).agg(F.max("_total").alias("n"), *aggs, F.max("max_value").alias("max_value"))


def weighted_median(df: DataFrame, key: str, value: str, weight: str, width: float) -> DataFrame:
    """First value at which half of the weight is reached; on an exact half the mean with the next value."""
    summed = df.groupBy(key, value).agg(F.sum(F.greatest(F.col(weight), F.lit(0))).alias("_w"))
    running = with_running_sum(summed, key, [value], F.col("_w"), "_upto", width)
    totals = summed.groupBy(key).agg((F.sum("_w") / 2).alias("_half"))
    joined = running.join(totals, key).where(F.col("_half") > 0)
    return joined.groupBy(key).agg(
        F.min(F.when(F.col("_upto") >= F.col("_half"), F.col(value))).alias("_low"),
        F.min(F.when(F.col("_upto") > F.col("_half"), F.col(value))).alias("_high")).select(
        key, F.when(F.col("_low") == F.coalesce("_high", "_low"), F.col("_low")).otherwise(
            (F.col("_low") + F.col("_high")) / 2).alias("weighted_median"))
