"""Helpers of the operators: tables, scratch tables in the shared folder, bounded-batch Python tasks."""
from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder. Arrow batches are kept small, because one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir; a temporary one where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and a lost executor only costs its own tasks."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table that ``saved`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(name)
        with contextlib.suppress(Exception):
            path.getFileSystem(conf).delete(path, True)


WHOLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype(), pa.int16(): pd.Int16Dtype(), pa.int8(): pd.Int8Dtype()}.get


def map_frames(df: DataFrame, run, schema: str | T.StructType) -> DataFrame:
    """``mapInPandas`` whose whole numbers stay exact: a null in a batch does not turn its ids into floats, but is ``pd.NA``."""
    made = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    arrow = to_arrow_schema(made)

    def batches(given):
        for pdf in run(b.to_pandas(types_mapper=WHOLE) for b in given):
            yield pa.RecordBatch.from_pandas(pdf, schema=arrow, preserve_index=False)

    return df.mapInArrow(batches, made)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete what finished jobs left on the executors' disks: it does so once the driver's collector has seen that nothing refers to it.

    Jobs of many rounds make hundreds of small shuffles, which would otherwise lie there until the collector happens to run.
    """
    gc.collect()
    spark._jvm.System.gc()


def filled(df: DataFrame, column: str) -> DataFrame:
    """Null becomes the empty string."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit("")))


def salts_for(rows: int, per_group: int = 50_000, least: int = 64) -> int:
    """How many shares a key's rows are split over, so that a key with a third of all rows still gives small groups."""
    return max(least, rows // per_group)


BROADCAST_IDS = 1_000_000


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``ids`` (a saved table). Ids are counted first: up to a million are sent to the
    executors, so that long texts stay where they are; beyond that the join shuffles."""
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(ids, key, "left_semi")


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII expression in DuckDB's SQL, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x: {step}), 4294967295::BIGINT)"
