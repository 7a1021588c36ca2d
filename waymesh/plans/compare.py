"""Comparison of two versions of a layer."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_set_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Rows that only one version has, copies counted."""
    only_current = current.exceptAll(baseline).select(F.lit("only_in_current").alias("side"), "*")
    return only_current.unionAll(baseline.exceptAll(current).select(F.lit("only_in_baseline"), "*"))


def _fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of a layer: number of rows and the sums of both halves of their hashes."""
    h = F.sha2(F.to_json(F.struct(*sorted(columns))), 256)

    def part(start: int):
        return F.sum(F.conv(F.substring(h, start, 12), 16, 10).cast("decimal(20,0)"))

    return df.agg(F.count("*").alias("rows"), part(1).alias("a"), part(13).alias("b")).select(
        F.concat_ws("-", "rows", "a", "b").alias("print"))


def layer_hash_status(current: DataFrame, baseline: DataFrame, layer: str, semantic_only: list[str]) -> DataFrame:
    """PASS when all columns agree, SCHEMA_MIGRATION_DIFFERENCE when only the meaning does, else FAIL.

    ``semantic_only`` names the columns that carry the meaning.
    """
    raw_a, raw_b = _fingerprint(current, current.columns), _fingerprint(baseline, baseline.columns)
    sem_a, sem_b = _fingerprint(current, semantic_only), _fingerprint(baseline, semantic_only)
    # every side is one row
    joined = (raw_a.toDF("ra").join(F.broadcast(raw_b.toDF("rb"))).join(F.broadcast(sem_a.toDF("sa"))).join(F.broadcast(sem_b.toDF("sb"))))
    status = F.when(F.col("ra") == F.col("rb"), "PASS").when(F.col("sa") == F.col("sb"), "SCHEMA_MIGRATION_DIFFERENCE").otherwise("FAIL")
    return joined.select(F.lit(layer).alias("layer"), status.alias("status"))
