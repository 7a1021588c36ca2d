"""Surfaces as grid cells: connected masks, holes and forbidden ground."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .graph import unit_components


def _components(cells: DataFrame) -> DataFrame:
    """Component of every cell (four neighbours) per unit; ``cells`` are distinct.

    Cells that follow each other in a column are one run, named by its first cell, so the rounds see runs instead of cells.
    """
    column = Window.partitionBy("unit", "cx").orderBy("cy")
    first = F.when(F.coalesce(F.col("cy") - F.lag("cy").over(column) != 1, F.lit(True)), F.col("cy"))
    marked = cells.select("unit", "cx", "cy", first.alias("_first"))
    runs = cut(marked.select("unit", "cx", "cy", F.struct("cx", F.last("_first", True).over(column).alias("cy")).alias("run")))
    beside = runs.select("unit", (F.col("cx") - 1).alias("cx"), "cy", F.col("run").alias("dst"))
    links = runs.select("unit", "cx", "cy", F.col("run").alias("src")).join(beside, ["unit", "cx", "cy"]).select("unit", "src", "dst").distinct()
    comp = unit_components(links)
    return runs.join(comp.withColumnRenamed("node", "run"), ["unit", "run"], "left").select(
        "unit", "cx", "cy", F.coalesce("component", "run").alias("component"))


def assemble_surface(allowed: DataFrame, seeds: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Cells of each unit's surface: allowed parts that hold a seed, holes filled, forbidden cells out.

    All three inputs hold ``unit, cx, cy``.
    """
    free = allowed.select("unit", "cx", "cy").distinct().join(forbidden.select("unit", "cx", "cy").distinct(), ["unit", "cx", "cy"], "left_anti")
    parts = _components(free)
    seeded = parts.join(seeds.select("unit", "cx", "cy").distinct(), ["unit", "cx", "cy"], "left_semi").select("unit", "component").distinct()
    mask = parts.join(seeded, ["unit", "component"], "left_semi").select("unit", "cx", "cy")
    box = mask.groupBy("unit").agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"), F.max("cy").alias("y1"))
    frame = box.select("unit", "x0", "y0", F.explode(F.sequence(F.col("x0") - 1, F.col("x1") + 1)).alias("cx"), "y1").select(
        "unit", "x0", "y0", "cx", F.explode(F.sequence(F.col("y0") - 1, F.col("y1") + 1)).alias("cy"))
    empty = frame.join(mask, ["unit", "cx", "cy"], "left_anti")
    around = _components(empty.select("unit", "cx", "cy"))
    corner = box.select("unit", (F.col("x0") - 1).alias("cx"), (F.col("y0") - 1).alias("cy"))
    outside = around.join(corner, ["unit", "cx", "cy"], "left_semi").select("unit", "component")
    holes = around.join(outside, ["unit", "component"], "left_anti").select("unit", "cx", "cy")
    filled = holes.join(forbidden.select("unit", "cx", "cy").distinct(), ["unit", "cx", "cy"], "left_anti")
    return mask.withColumn("part", F.lit("seeded")).unionAll(filled.withColumn("part", F.lit("hole")))
