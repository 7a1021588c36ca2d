"""Label tables and measures over scored objects."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage_by_task(df: DataFrame, key: str, tasks: dict[str, Column]) -> DataFrame:
    """Labelled objects per key and how many of them serve each task."""
    return df.groupBy(key).agg(*[F.count_if(cond).alias(name) for name, cond in tasks.items()], F.count("*").alias("labelled"))
