"""Smaller follow-up tables: summaries, fallbacks and comparisons."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relation_fallback(rows: DataFrame) -> DataFrame:
    """Targets whose surface was rejected but whose carriers resolve to one group succeed; others get a reason."""
    per = rows.groupBy("target_id").agg(F.min("base_id").alias("lo"), F.max("base_id").alias("hi"))
    state = F.when(F.col("lo").isNull(), "no_carrier").when(F.col("lo") == F.col("hi"), "success").otherwise("several_carriers")
    return per.select("target_id", state.alias("state"), F.when(state == "success", F.col("lo")).alias("base_id"))


def owner_mix(rows: DataFrame) -> DataFrame:
    """Whether the lanes of one old road have no, one or several owners."""
    per = rows.groupBy("old_road").agg(F.count("*").alias("lanes"), F.min("owner").alias("lo"), F.max("owner").alias("hi"))
    return per.select("old_road", "lanes", F.when(F.col("lo").isNull(), "none").when(F.col("lo") == F.col("hi"), "single").otherwise("mixed").alias("mix"))


def changed_segments(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Segments whose input fingerprint is new or different."""
    return current.join(previous, ["segment_id", "print"], "left_anti").select("segment_id")


def fingerprints(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Order-free fingerprint of the input rows of each segment."""
    return rows.groupBy("segment_id").agg(F.concat_ws("-", F.count("*"), F.sum(F.crc32(F.concat_ws("|", *columns)))).alias("print"))
