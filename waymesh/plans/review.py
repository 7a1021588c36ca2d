"""Review lists: context of open relations, priorities and manual decisions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import neighbour_cells, salted_cell_join, with_cell
from ..operators.topk import top_k


def carrier_context(nodes: DataFrame, carriers: DataFrame, limit: float, k: int) -> DataFrame:
    """Number of carrier features within ``limit`` of each node, the nearest distance and the ``k`` nearest ids.

    Features at one place are counted once with their number and first ``k`` ids, so copies cost nothing.
    """
    counted = carriers.groupBy("fx", "fy").agg(F.count("*").alias("n"))
    firsts = top_k(carriers, ["fx", "fy"], [F.col("feature_id")], k).groupBy("fx", "fy").agg(
        F.collect_list("feature_id").alias("ids"))
    places = with_cell(counted.join(firsts, ["fx", "fy"]), "fx", "fy", limit).withColumn("place", F.struct("fx", "fy"))
    at = with_cell(nodes.select("x", "y").distinct(), "x", "y", limit)
    dist = F.sqrt((F.col("x") - F.col("fx")) ** 2 + (F.col("y") - F.col("fy")) ** 2)
    near = salted_cell_join(neighbour_cells(at), places, "place").withColumn("d", dist).where(F.col("d") <= limit)
    totals = near.groupBy("x", "y").agg(F.sum("n").alias("feature_count"), F.min("d").alias("d"))
    best = top_k(near.select("x", "y", "d", F.explode("ids").alias("feature_id")), ["x", "y"],
                 [F.col("d"), F.col("feature_id")], k).groupBy("x", "y").agg(
        F.array_join(F.array_sort(F.collect_list("feature_id")), ",").alias("nearest_ids"))
    context = totals.join(best, ["x", "y"])
    return nodes.join(context, ["x", "y"], "left").select(
        "id", F.coalesce("feature_count", F.lit(0)).alias("feature_count"), F.round("d", 3).alias("nearest_m"),
        F.coalesce("nearest_ids", F.lit("")).alias("nearest_ids"))


def repair_candidates(gaps: DataFrame) -> DataFrame:
    """One row per target with the number of audit rows and segments behind it."""
    return gaps.groupBy(F.col("node_id").alias("target_id")).agg(F.count("*").alias("evidence_rows"), F.count_distinct("segment_id").alias("segments"))


def review_priority(rows: DataFrame) -> DataFrame:
    """Context bucket of each segment from the context of its junctions."""
    per = rows.groupBy("segment_id").agg(F.bool_and("has_context").alias("e"), F.bool_or("has_context").alias("s"))
    return per.select("segment_id", F.when(F.col("e"), "0_all_nodes_have_context").when(F.col("s"), "1_partial_context").otherwise("2_no_context").alias("bucket"))


def gap_class(rows: DataFrame) -> DataFrame:
    """Class of a relation gap by status, base, consumability and source."""
    good = (F.col("status") == 0) & (F.col("base_id") > 0)
    cls = (F.when(good & F.col("consumable") & ~F.col("manual"), "already_machine_consumable").when(good & F.col("consumable"), "manual_consumed_graph_consumable")
           .when(good, "relation_success_but_graph_unconsumable").when(F.col("status") != 0, "manual_can_fix_machine_relation_failure").otherwise("manual_relation_needs_review"))
    return rows.select("target_id", cls.alias("gap_class"))


def manual_apply(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """State of every manual row: duplicate, rejected with a reason, or actionable."""
    counts = rows.groupBy("target_id").agg(F.count("*").alias("_n"))
    joined = rows.join(counts, "target_id").join(targets.withColumn("_t", F.lit(True)), "target_id", "left")
    state = F.when(F.col("_n") > 1, "duplicate_target").when(F.col("base_id") == 0, "rejected_no_base").when(F.col("_t").isNull(), "rejected_unknown_target").otherwise("actionable")
    return joined.select("target_id", "base_id", state.alias("state"))


def metrics_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    joined = before.withColumnRenamed("n", "_b").join(after.withColumnRenamed("n", "_a"), "metric", "full_outer")
    return joined.select("metric", (F.coalesce("_a", F.lit(0)) - F.coalesce("_b", F.lit(0))).alias("change"))


def case_slice(nodes: DataFrame, roads: DataFrame, x: float, y: float, radius: float, forced: DataFrame) -> DataFrame:
    """Roads with an end at a node inside the window or forced into the case."""
    inside = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) <= radius * radius
    chosen = nodes.where(inside).select("id").union(forced.select("id")).distinct()
    ends = roads.select(F.col("id").alias("road_id"), F.explode(F.array("snodeid", "enodeid")).alias("id"))
    return ends.join(chosen, "id", "left_semi").select("road_id").distinct()
