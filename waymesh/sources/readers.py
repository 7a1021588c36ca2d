"""Readers of road layers: GeoJSON, nested request payloads, audit CSV and patch folders."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPOT = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "spotId", "name", "lon", "lat", "distance", "walkDistance", "isRecommend", "type", "linkId", "linkCoors",
    "location", "originId", "isNparking")])
CENTER = T.StructType([T.StructField(n, T.StringType()) for n in (
    "id", "spotId", "name", "lon", "lat", "type", "adcode", "cityAdcode", "provinceAdcode", "districtAdcode")])
CARD = T.StructType([T.StructField(n, T.StringType()) for n in ("selectedShowId", "cardStyle", "title")])
PAYLOAD = T.StructType([
    T.StructField("tid", T.StringType()), T.StructField("gd_id", T.StringType()),
    T.StructField("lon", T.StringType()), T.StructField("lat", T.StringType()),
    T.StructField("success", T.StringType()), T.StructField("crawl_time", T.StringType()),
    T.StructField("other_args", T.StructType([T.StructField("db", T.StringType()), T.StructField("table_name", T.StringType())])),
    T.StructField("data", T.StructType([
        T.StructField("location", CENTER), T.StructField("card", CARD), T.StructField("hadRecommend", T.StringType()),
        T.StructField("hadSpotImage", T.StringType()), T.StructField("list", T.ArrayType(SPOT))])),
    T.StructField("_corrupt", T.StringType())])

LINE_FEATURE = ("struct<type:string,properties:map<string,string>,"
                "geometry:struct<type:string,coordinates:array<array<double>>>>")
POINT_FEATURE = ("struct<type:string,properties:map<string,string>,"
                 "geometry:struct<type:string,coordinates:array<double>>>")


def _line(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda c: F.struct(c[0].alias("x"), c[1].alias("y")))


def features_from_text(df: DataFrame, column: str, kind: str = "line") -> DataFrame:
    """One GeoJSON feature per row of text → ``properties`` map and ``pts`` or ``x, y``."""
    parsed = df.select(F.from_json(column, LINE_FEATURE if kind == "line" else POINT_FEATURE).alias("f"))
    return _feature_columns(parsed, kind)


def _feature_columns(parsed: DataFrame, kind: str) -> DataFrame:
    at = F.col("f.geometry.coordinates")
    shape = [_line(at).alias("pts")] if kind == "line" else [at[0].alias("x"), at[1].alias("y")]
    return parsed.select(F.col("f.properties").alias("properties"), *shape)


def read_geojson(spark: SparkSession, path: str, kind: str = "line", one_feature_per_line: bool = False) -> DataFrame:
    """Features of GeoJSON files, with the CRS name of the file header where there is one.

    A FeatureCollection is one JSON value, so one file is one read task; large layers should be
    written with one feature per line, which splits freely.
    """
    if one_feature_per_line:
        return features_from_text(spark.read.text(path), "value", kind).withColumn("crs", F.lit(None).cast("string"))
    feature = LINE_FEATURE if kind == "line" else POINT_FEATURE
    schema = f"type string, crs struct<properties:struct<name:string>>, features array<{feature}>"
    collection = spark.read.schema(schema).json(path, multiLine=True)
    rows = collection.select(F.col("crs.properties.name").alias("crs"), F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    shape = [_line(at).alias("pts")] if kind == "line" else [at[0].alias("x"), at[1].alias("y")]
    return rows.select(F.col("f.properties").alias("properties"), *shape, "crs")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Nested request payloads, one JSON value per line; bad lines keep their text in ``_corrupt``."""
    return spark.read.schema(PAYLOAD).option("columnNameOfCorruptRecord", "_corrupt").json(path)


def payloads_from_text(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.from_json(column, PAYLOAD, {"columnNameOfCorruptRecord": "_corrupt"}).alias("p")).select("p.*")


def _flag(c: Column) -> Column:
    text = F.lower(F.trim(c))
    return F.when(text.isin("1", "true", "yes"), 1).when(text.isin("0", "false", "no"), 0)


def recommended_points(payloads: DataFrame) -> DataFrame:
    """Recommended spots with valid positions, flattened to one row of plain columns each."""
    spots = payloads.select("*", F.explode("data.list").alias("s"))
    lon, lat = F.col("s.lon").try_cast("double"), F.col("s.lat").try_cast("double")
    valid = (_flag(F.col("s.isRecommend")) == 1) & lon.between(-180, 180) & lat.between(-90, 90)
    return spots.where(valid).select(
        F.lit("raw_lonlat_unconfirmed").alias("source_crs"),
        F.coalesce("s.id", "s.spotId").alias("spot_id"), F.col("s.name").alias("name"),
        F.col("s.distance").alias("distance"), F.col("s.walkDistance").alias("walk_distance"),
        _flag(F.col("s.isRecommend")).alias("is_recommend"), F.col("s.type").alias("type"),
        F.col("s.linkId").alias("link_id"), F.col("s.linkCoors").alias("link_coors"),
        F.col("s.location").alias("location"), F.col("s.originId").alias("origin_id"),
        _flag(F.col("s.isNparking")).alias("is_nparking"), F.col("tid").alias("req_tid"),
        F.col("gd_id").alias("req_gd_id"), F.col("lon").alias("req_lon"), F.col("lat").alias("req_lat"),
        _flag(F.col("success")).alias("req_success"), F.col("other_args.db").alias("req_db"),
        F.col("other_args.table_name").alias("req_table_name"),
        F.coalesce("data.location.id", "data.location.spotId").alias("cen_id"),
        F.col("data.location.name").alias("cen_name"), F.col("data.location.lon").alias("cen_lon"),
        F.col("data.location.lat").alias("cen_lat"), F.col("data.location.type").alias("cen_type"),
        F.col("data.location.adcode").alias("adcode"), F.col("data.location.cityAdcode").alias("city_adcode"),
        F.col("data.location.provinceAdcode").alias("province_adcode"),
        F.col("data.location.districtAdcode").alias("district_adcode"),
        F.col("data.card.selectedShowId").alias("selected_show_id"), F.col("data.card.cardStyle").alias("card_style"),
        F.col("data.card.title").alias("card_title"), _flag(F.col("data.hadRecommend")).alias("had_recommend"),
        _flag(F.col("data.hadSpotImage")).alias("had_spot_image"), F.col("crawl_time"),
        lon.alias("lon"), lat.alias("lat"))


def read_csv_rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Audit CSV with a header, every column as text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)


def read_patches(spark: SparkSession, root: str, layer: str, schema: str) -> DataFrame:
    """One layer of every numbered patch folder below ``root``, tagged with ``patch_id``."""
    rows = spark.read.schema(schema).json(f"{root}/[0-9]*/{layer}", multiLine=False)
    return rows.withColumn("patch_id", F.regexp_extract(F.col("_metadata.file_path"), r"/([0-9]+)/[^/]*$", 1))


def rows_per_source(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows per file name over several folders or files of any schema."""
    parts = [spark.read.parquet(p).select(F.regexp_extract("_metadata.file_name", r"^([a-z_]+)", 1).alias("layer"))
             for p in paths]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union.groupBy("layer").agg(F.count("*").alias("row_count"))
