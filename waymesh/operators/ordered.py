"""Running computations along an order, in two levels so that one long group spans many tasks.

Every group is cut into chunks by a bounded stretch of the order column. Windows run inside the
chunks; only one summary row per chunk takes part in the pass over the whole group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _chunked(df: DataFrame, order: str, width: float) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / width))


def with_previous(df: DataFrame, key: str, order: list[str], columns: list[str], width: float) -> DataFrame:
    """Add ``prev_<c>`` of the row before, within ``key`` and by ``order`` (whose first column is numeric)."""
    chunks = _chunked(df, order[0], width)
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    local = chunks.withColumns({"_rn": F.row_number().over(inside),
                                "_prev": F.lag(F.struct(*columns)).over(inside)})
    last = chunks.groupBy(key, "_chunk").agg(F.max(F.struct(*order, F.struct(*columns).alias("_row")))["_row"].alias("_last"))
    across = Window.partitionBy(key).orderBy("_chunk")
    carried = last.select(key, "_chunk", F.lag("_last").over(across).alias("_carried"))
    joined = local.join(carried, [key, "_chunk"], "left")
    prev = F.when(F.col("_rn") == 1, F.col("_carried")).otherwise(F.col("_prev"))
    return joined.withColumn("_p", prev).select(*df.columns, *[F.col("_p")[c].alias(f"prev_{c}") for c in columns])


def with_running_sum(df: DataFrame, key: str, order: list[str], value: Column, name: str, width: float) -> DataFrame:
    """Add the inclusive running sum of ``value`` within ``key`` and by ``order``."""
    chunks = _chunked(df, order[0], width).withColumn("_v", value)
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = chunks.withColumn("_local", F.sum("_v").over(inside))
    totals = chunks.groupBy(key, "_chunk").agg(F.sum("_v").alias("_total"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(key, "_chunk", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    return local.join(prefix, [key, "_chunk"]).select(*df.columns, (F.col("_before") + F.col("_local")).alias(name))


def sessionize(df: DataFrame, key: str, order: list[str], is_break: Column, compare: list[str], width: float,
               name: str = "part_no") -> DataFrame:
    """Number the stretches of each group; a new one starts where ``is_break`` holds against ``prev_*``."""
    previous = with_previous(df, key, order, compare, width)
    flagged = previous.withColumn("_break", F.coalesce(is_break, F.lit(False)).cast("int"))
    numbered = with_running_sum(flagged, key, order, F.col("_break"), name, width)
    return numbered.drop("_break")
