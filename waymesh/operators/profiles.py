"""Row counts, gaps and bounds of layers, and copy-on-write attribute updates."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G


def profile(df: DataFrame, keys: list[str], required: list[str], geometry: str = "pts") -> DataFrame:
    """Counts, missing values, bounds and an order-free content hash, in one aggregation."""
    box = G.bounds(F.col(geometry))
    columns = [c for c in df.columns if c != geometry]
    row_hash = F.pmod(F.crc32(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])), F.lit(1000003))
    return df.groupBy(*keys).agg(
        F.count("*").alias("row_count"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required],
        F.count_if(F.size(geometry) < 2).alias("invalid_geometry"),
        F.min(box["minx"]).alias("minx"), F.min(box["miny"]).alias("miny"),
        F.max(box["maxx"]).alias("maxx"), F.max(box["maxy"]).alias("maxy"),
        F.sum(row_hash).alias("content_sum"))


def update_by_id(df: DataFrame, updates: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """New frame in which ``value_col`` takes the value of ``updates`` where the id occurs there."""
    new = updates.select(id_col, F.col(value_col).alias("_new"))
    joined = df.join(new, id_col, "left")
    return joined.withColumn(value_col, F.coalesce("_new", value_col)).drop("_new")
