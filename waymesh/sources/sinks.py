"""Writers of road layers."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def write_partitioned(df: DataFrame, path: str, partition_by: str, sort_by: list[str], files_per_partition: int = 1) -> None:
    """Parquet by partition folder, rows sorted so that bounds prune row groups.

    Rows of one folder are spread over ``files_per_partition`` tasks by a hash of the sort key.
    """
    spread = F.pmod(F.xxhash64(*sort_by), F.lit(files_per_partition))
    shuffled = df.repartition(F.col(partition_by), spread)
    shuffled.sortWithinPartitions(partition_by, *sort_by).write.partitionBy(partition_by).parquet(path)


def geojson_line(properties: list[str], pts: Column) -> Column:
    """GeoJSON text of one line feature."""
    coordinates = F.transform(pts, lambda p: F.array(p["x"], p["y"]))
    geometry = F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"),
                              F.struct(*properties).alias("properties")))


def write_geojson_lines(df: DataFrame, path: str, properties: list[str]) -> None:
    df.select(geojson_line(properties, F.col("pts")).alias("value")).write.text(path)
