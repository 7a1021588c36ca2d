"""Matching of lanes to owner roads and of samples to boundaries on either side."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .spatial import MIN_CELL_M, line_cells, salted_cell_join, with_cell


def lane_samples(lanes: DataFrame, spacing: float) -> DataFrame:
    """Samples of lane lines with the direction of the lane's chord."""
    chord = G.bearing(F.col("pts")[0], F.element_at("pts", -1))
    rows = lanes.select("lane_id", chord.alias("lane_deg"), F.posexplode(G.sample(F.col("pts"), spacing)).alias("i", "p"))
    return rows.select("lane_id", "lane_deg", "i", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def sample_piece_pairs(samples: DataFrame, lines: DataFrame, limit: float, *of_line: str) -> DataFrame:
    """Each sample with the nearest piece of every line within ``limit``: distance, side and piece direction.

    A sample and all pieces near it meet in one cell, so the nearest is taken there without a further shuffle.
    ``of_line`` names columns of ``lines`` that come along; they have one value per line.
    """
    cell = max(2 * limit, MIN_CELL_M)
    cells = line_cells(lines.select("line_id", "pts", *of_line), cell, limit).select("line_id", "p", "cx", "cy", *of_line)
    pairs = salted_cell_join(with_cell(samples, "x", "y", cell), cells, "line_id")
    p = F.col("p")
    cross = (p["x1"] - p["x0"]) * (F.col("y") - p["y0"]) - (p["y1"] - p["y0"]) * (F.col("x") - p["x0"])
    heading = G.bearing(F.struct(p["x0"].alias("x"), p["y0"].alias("y")), F.struct(p["x1"].alias("x"), p["y1"].alias("y")))
    found = pairs.withColumns({"dist": G.point_piece_distance(F.col("x"), F.col("y"), p), "cross": cross, "line_deg": heading})
    near = found.where(F.col("dist") <= limit)
    return near.groupBy("cx", "cy", "salt", "lane_id", "i", "line_id").agg(
        F.min(F.struct("dist", "line_deg", "cross", "lane_deg", *of_line)).alias("b")).select("lane_id", "i", "line_id", "b.*")


def direction_delta(lane_deg: Column, road_deg: Column, direction: Column) -> Column:
    """Angle between a lane and a road in its allowed direction of travel."""
    along = G.angular_distance(lane_deg, road_deg)
    against = G.angular_distance(lane_deg, road_deg + 180)
    return F.when(direction == 2, along).when(direction == 3, against).otherwise(F.least(along, against))


def owner_candidates(samples: DataFrame, roads: DataFrame, limit: float) -> DataFrame:
    """Score of every road near a lane: median distance + 0.25 · p90 + 0.10 · median direction difference."""
    pairs = sample_piece_pairs(samples, roads, limit, "direction")
    delta = direction_delta(F.col("lane_deg"), F.col("line_deg"), F.col("direction"))
    grouped = pairs.withColumn("delta", delta).groupBy("lane_id", "line_id").agg(
        F.percentile("dist", 0.5).alias("p50"), F.percentile("dist", 0.9).alias("p90"),
        F.percentile("delta", 0.5).alias("delta"), F.count("*").alias("samples"))
    return grouped.withColumn("owner_score", F.col("p50") + 0.25 * F.col("p90") + 0.10 * F.col("delta"))


def boundary_widths(samples: DataFrame, boundaries: DataFrame, limit: float, max_turn: float) -> DataFrame:
    """Width per lane from the nearest boundary on each side of every sample."""
    pairs = sample_piece_pairs(samples, boundaries, limit)
    turn = G.angular_distance(F.col("lane_deg"), F.col("line_deg"))
    parallel = pairs.where((F.col("dist") >= 0.05) & (F.least(turn, 180 - turn) <= max_turn))
    # the boundary is on the left when the sample is on the right of a boundary running the lane's way
    same_way = G.angular_distance(F.col("lane_deg"), F.col("line_deg")) <= 90
    left = F.when(same_way, F.col("cross") < 0).otherwise(F.col("cross") > 0)
    sides = parallel.groupBy("lane_id", "i").agg(
        F.min(F.when(left, F.struct("dist", "line_id"))).alias("l"), F.min(F.when(~left, F.struct("dist", "line_id"))).alias("r"))
    width = F.col("l.dist") + F.col("r.dist")
    return sides.groupBy("lane_id").agg(
        F.count("l").alias("left_samples"), F.count("r").alias("right_samples"), F.count(width).alias("both_samples"),
        F.percentile(width, 0.5).alias("width_median"), F.percentile(width, 0.9).alias("width_p90"),
        F.percentile(width, 0.1).alias("width_p10"))
