"""Key joins between road layers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import normalize_id


def patch_lists(patch_roads: DataFrame) -> DataFrame:
    """Sorted distinct patches per road; the distinct runs map-side before the shuffle."""
    keyed = patch_roads.select(normalize_id(F.col("road_id")).alias("road_key"), "patch_id").where(F.col("road_key").isNotNull())
    return keyed.groupBy("road_key").agg(F.array_join(F.array_sort(F.collect_set("patch_id")), ",").alias("patch_ids"))


def patch_join(roads: DataFrame, patch_roads: DataFrame) -> DataFrame:
    """Every road with its patch list and the reason when it has none."""
    keyed = roads.withColumn("road_key", normalize_id(F.col("id")))
    joined = keyed.join(patch_lists(patch_roads), "road_key", "left")
    reason = F.when(F.col("road_key").isNull(), "missing road id").when(F.col("patch_ids").isNull(), "no patch road match")
    return joined.withColumn("reason", reason)


def restriction_pairs(conditions: DataFrame, roads: DataFrame, cond_type: int = 1) -> DataFrame:
    """Conditions of one type with the lines of their in-road and out-road; missing sides stay null."""
    lines = roads.select("id", "pts")
    chosen = conditions.where(F.col("cond_type") == cond_type)
    with_in = chosen.join(lines.select(F.col("id").alias("in_link"), F.col("pts").alias("in_pts")), "in_link", "left")
    return with_in.join(lines.select(F.col("id").alias("out_link"), F.col("pts").alias("out_pts")), "out_link", "left")


def canonical_nodes(nodes: DataFrame) -> DataFrame:
    """``node_id`` → ``canonical_id``: the main node where one is named, else the node itself."""
    main = F.when(F.col("mainnodeid") != 0, F.col("mainnodeid"))
    return nodes.select(F.col("id").alias("node_id"), F.coalesce(main, F.col("id")).alias("canonical_id"))


def with_canonical_ends(roads: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add ``src`` and ``dst`` as junctions; ends without an alias keep their own id."""
    start = aliases.select(F.col("node_id").alias("snodeid"), F.col("canonical_id").alias("_s"))
    end = aliases.select(F.col("node_id").alias("enodeid"), F.col("canonical_id").alias("_e"))
    return (roads.join(start, "snodeid", "left").join(end, "enodeid", "left")
            .withColumns({"src": F.coalesce("_s", "snodeid"), "dst": F.coalesce("_e", "enodeid")}).drop("_s", "_e"))


def keep_roads_with_both_ends(roads: DataFrame, node_ids: DataFrame) -> DataFrame:
    ids = node_ids.select(F.col("node_id"))
    kept = roads.join(ids, roads.snodeid == ids.node_id, "left_semi")
    return kept.join(ids, kept.enodeid == ids.node_id, "left_semi")


def missing_ends(roads: DataFrame, node_ids: DataFrame) -> DataFrame:
    """Road ends that name a node that does not exist."""
    ends = roads.select("id", F.explode(F.array(
        F.struct(F.lit("start").alias("end"), F.col("snodeid").alias("node_id")),
        F.struct(F.lit("end").alias("end"), F.col("enodeid").alias("node_id")))).alias("e")).select("id", "e.*")
    return ends.join(node_ids.select("node_id"), "node_id", "left_anti")


def relation_map(relations: DataFrame, order: Column) -> DataFrame:
    """One relation per target: the last by ``order``."""
    return relations.groupBy("target_id").agg(F.max_by(F.struct("base_id", "status"), order).alias("r")).select(
        "target_id", "r.base_id", "r.status")


def relation_lookup(segment_nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Map the junctions of every segment through the relation.

    ``segment_nodes`` holds ``segment_id, pos, role, node_id`` with a handful of rows per segment. The
    first failing end names the reason, then the first failing inner junction.
    """
    rows = segment_nodes.join(relations, segment_nodes.node_id == relations.target_id, "left")
    reason = (F.when(F.col("target_id").isNull(), F.concat(F.lit("missing_"), "role", F.lit("_relation")))
              .when(F.col("status") != 0, F.concat(F.lit("invalid_"), "role", F.lit("_relation_status")))
              .when(F.col("base_id") <= 0, F.concat(F.lit("invalid_"), "role", F.lit("_base_id"))))
    checked = rows.withColumn("reason", reason)
    failed = F.when(F.col("reason").isNotNull(), F.struct((F.col("role") != "pair").alias("inner"), "pos", "reason"))
    mapped = F.collect_list(F.when(F.col("reason").isNull(), F.struct("pos", "base_id")))
    grouped = checked.groupBy("segment_id").agg(
        F.min(failed)["reason"].alias("reason"), F.count("reason").alias("failed_nodes"), mapped.alias("m"))
    return grouped.select("segment_id", F.col("reason").isNull().alias("passed"), "reason", "failed_nodes",
                          F.array_join(F.transform(F.array_sort("m"), lambda s: s["base_id"]), ",").alias("base_ids"))


def compare_versions(current: DataFrame, baseline: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Status of every key over two versions: same, changed, only_current or only_baseline."""
    a = current.select(*keys, F.struct(*values).alias("_a"))
    b = baseline.select(*keys, F.struct(*values).alias("_b"))
    status = (F.when(F.col("_b").isNull(), "only_current").when(F.col("_a").isNull(), "only_baseline")
              .when(F.col("_a") == F.col("_b"), "same").otherwise("changed"))
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def station_range_join(stations: DataFrame, ranges: DataFrame, width: float) -> DataFrame:
    """Stations inside the ranges of the same road, joined on stretches of ``width``.

    ``stations`` holds ``road_id, s``; ``ranges`` holds ``road_id, start_m, end_m, range_id``.
    """
    left = stations.withColumn("_cell", F.floor(F.col("s") / width))
    right = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start_m") / width), F.floor(F.col("end_m") / width))))
    return left.join(right, ["road_id", "_cell"]).where(F.col("s").between(F.col("start_m"), F.col("end_m"))).drop("_cell")
