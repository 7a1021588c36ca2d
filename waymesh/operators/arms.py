"""Junction arms: directions in which roads leave a junction, and the movements between them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

SECTOR_DEG = 15


def incident_ends(roads: DataFrame) -> DataFrame:
    """One row per road and junction end with its role and outward direction of the whole line.

    ``roads`` holds ``id, src, dst, direction, pts``; roads inside one junction have no outward end.
    """
    def end(node: str, inside: bool) -> Column:
        return F.struct(F.col(node).alias("junction_id"), F.lit(inside).alias("at_start"))

    rows = roads.where(F.col("src") != F.col("dst")).select(
        "id", "direction", "pts", F.explode(F.array(end("src", True), end("dst", False))).alias("e")).select("*", "e.*").drop("e")
    first, last = F.col("pts")[0], F.element_at("pts", -1)
    dx = F.when(F.col("at_start"), last["x"] - first["x"]).otherwise(first["x"] - last["x"])
    dy = F.when(F.col("at_start"), last["y"] - first["y"]).otherwise(first["y"] - last["y"])
    angle = F.degrees(F.atan2(dy, dx))
    return rows.select("junction_id", "id", S.road_role(F.col("direction"), F.col("at_start")).alias("role"),
                       F.when((F.abs(dx) > 1e-9) | (F.abs(dy) > 1e-9), F.when(angle < 0, angle + 360).otherwise(angle)).alias("angle"))


def sector_arms(ends: DataFrame, sector_deg: int = SECTOR_DEG) -> DataFrame:
    """Arms of a junction as sectors of the circle; at most 360 / ``sector_deg`` rows per junction.

    Counts are combined map-side, so a junction with very many road ends still yields few rows.
    """
    sector = F.floor(F.col("angle") / sector_deg).cast("int")
    inbound, outbound = F.col("role").isin("inbound", "bidirectional"), F.col("role").isin("outbound", "bidirectional")
    return ends.where(F.col("angle").isNotNull()).groupBy("junction_id", sector.alias("sector")).agg(
        F.count("*").alias("roads"), F.count_if(inbound).alias("roads_in"), F.count_if(outbound).alias("roads_out"),
        F.min("id").alias("first_road_id"))


def movement_cross(arms: DataFrame) -> DataFrame:
    """Arm pairs of a junction, from every arm that can be entered from to every arm that can be left by."""
    source = arms.where(F.col("roads_in") > 0).select("junction_id", F.col("sector").alias("from_sector"), "roads_in")
    target = arms.where(F.col("roads_out") > 0).select("junction_id", F.col("sector").alias("to_sector"), "roads_out")
    return source.join(target, "junction_id")


def movement_type(entry_x: Column, entry_y: Column, exit_x: Column, exit_y: Column, same_arm: Column) -> Column:
    """Turn type from travel vectors into and out of the junction."""
    norm = F.sqrt(entry_x * entry_x + entry_y * entry_y) * F.sqrt(exit_x * exit_x + exit_y * exit_y)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (entry_x * exit_x + entry_y * exit_y) / norm))
    cross = (entry_x * exit_y - entry_y * exit_x) / norm
    return (F.when(same_arm, "uturn").when(norm == 0, "unknown").when(F.degrees(F.acos(cosine)) <= 35, "straight")
            .when(F.abs(cross) <= 0.08, "unknown").when(cross > 0, "left").otherwise("right"))
