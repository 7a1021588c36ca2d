"""First rows per group without sorting whole groups.

A limit on ``row_number`` lets Spark keep only the first rows of each group per input partition
before the shuffle, and a struct minimum is combined map-side, so a group of any size is safe.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row that comes first in ``order`` for each key; the order must be total."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(rank)).where(F.col("_rn") <= 1).drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank_no") -> DataFrame:
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(rank)).where(F.col(name) <= k)


def full_rank(df: DataFrame, key: str, value: str, tie: str, name: str = "rank_no") -> DataFrame:
    """Rank of every row of a key by descending ``value`` and then ``tie``: rows are ranked within equal values, and the
    number of larger ones comes from counts per value, so no task sorts a whole key."""
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    above = counts.withColumn("_above", F.coalesce(F.sum("_n").over(
        Window.partitionBy(key).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = df.withColumn("_own", F.row_number().over(Window.partitionBy(key, value).orderBy(tie)))
    return own.join(above, [key, value]).withColumn(name, (F.col("_own") + F.col("_above")).cast("int")).select(*df.columns, name)


def margin_to_second(df: DataFrame, keys: list[str], score: str, id_col: str) -> DataFrame:
    """Best (lowest) score per key and its distance to the runner-up."""
    two = top_k(df.select(*keys, score, id_col), keys, [F.col(score), F.col(id_col)], 2, "_rn")
    return two.groupBy(*keys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(id_col))).alias("best_id"),
        F.max(F.when(F.col("_rn") == 1, F.col(score))).alias("best_score"),
        (F.max(F.when(F.col("_rn") == 2, F.col(score))) - F.max(F.when(F.col("_rn") == 1, F.col(score)))).alias("margin"))
