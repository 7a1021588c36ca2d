"""Quality audit of the fused network against its source."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import conflict_components, pairs_reachable
from ..operators.topk import top_k


def road_owners(scores: DataFrame) -> DataFrame:
    """Owner segment of every road: tight cover, broad cover, distance, id; equal scores are ambiguous.

    ``scores`` holds ``road_id, segment_id, tight, broad, dist``. Only the first two per road are needed.
    """
    order = [F.col("tight").desc(), F.col("broad").desc(), F.col("dist"), F.col("segment_id")]
    two = top_k(scores, ["road_id"], order, 2, "_rn")
    score = F.struct("tight", "broad", "dist")

    def at(n: int, value):
        return F.max(F.when(F.col("_rn") == n, value))

    picked = two.groupBy("road_id").agg(at(1, F.col("segment_id")).alias("owner_id"), at(1, score).alias("best"), at(2, score).alias("second"))
    ambiguous = F.coalesce(F.col("best") == F.col("second"), F.lit(False))
    return picked.select("road_id", "owner_id", ambiguous.alias("ambiguous"), "best.tight", "best.broad", "best.dist")


def required_directions(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Which of the two directions between the ends of each unit exist; both are searched in one run."""
    tagged = pairs.select("unit", F.explode(F.array(
        F.struct(F.lit("pair0_to_pair1").alias("way"), F.col("a").alias("a"), F.col("b").alias("b")),
        F.struct(F.lit("pair1_to_pair0").alias("way"), F.col("b").alias("a"), F.col("a").alias("b")))).alias("w")).select(
        F.struct("unit", "w.way").alias("unit"), "w.a", "w.b")
    ways = F.explode(F.array(F.lit("pair0_to_pair1"), F.lit("pair1_to_pair0"))).alias("way")
    keyed = edges.select(F.col("unit").alias("u"), "src", "dst", "road_id", ways).select(F.struct(F.col("u").alias("unit"), "way").alias("unit"), "src", "dst", "road_id")
    found = pairs_reachable(keyed, tagged)
    listed = found.groupBy("unit.unit").agg(F.array_sort(F.collect_set(F.when(F.col("reached"), F.col("unit.way")))).alias("d"))
    return pairs.join(listed, "unit").select("unit", "a", "b", F.array_join("d", ",").alias("directions"))


# Code, group and severity-bearing object of each quality issue.
ISSUES = {
    "segment_required_direction_unavailable": ("S01", "segment"), "segment_required_connection_missing": ("S02", "segment"),
    "segment_unexpected_reverse_passability": ("S03", "segment"), "junction_required_topology_missing": ("J01", "junction"),
    "junction_unmatched_support_topology": ("J02", "junction"), "junction_anchor_one_to_many": ("J03", "junction"),
    "junction_anchor_many_to_one": ("J04", "junction"),
}


def with_issue_code(rows: DataFrame) -> DataFrame:
    """Issue rows with their code and object type; unknown types keep null."""
    pairs = [F.lit(x) for kind, (code, obj) in ISSUES.items() for x in (kind, f"{code}|{obj}")]
    text = F.element_at(F.create_map(*pairs), F.col("issue_type"))
    return rows.withColumns({"issue_code": F.split(text, r"\|")[0], "object_type": F.split(text, r"\|")[1]})


def carrier_equivalence(paths: DataFrame) -> DataFrame:
    """Whether a carrier path stands for a source path: length ratio, extra length and distance within limits."""
    ratio = F.when(F.col("reference_m") > 0, F.col("length_m") / F.col("reference_m"))
    ok = (F.col("length_m") == 0) | (F.coalesce(ratio <= 1.5, F.lit(False)) & (F.col("length_m") - F.col("reference_m") <= 100) & (F.col("max_distance_m") <= 50))
    return paths.select("path_id", F.round(ratio, 6).alias("ratio"), ok.alias("accepted"))


def missing_directions(source: DataFrame, carrier: DataFrame, ends: DataFrame) -> DataFrame:
    """Directions a segment needs by its source that its carrier does not offer."""
    need = required_directions(source, ends).select("unit", F.explode(F.split("directions", ",")).alias("direction")).where("direction != ''")
    have = required_directions(carrier, ends).select("unit", F.explode(F.split("directions", ",")).alias("direction"))
    return need.join(have, ["unit", "direction"], "left_anti").withColumn("issue_type", F.lit("segment_required_direction_unavailable"))


def unexpected_reverse(source: DataFrame, carrier: DataFrame, ends: DataFrame) -> DataFrame:
    """Directions the carrier offers on segments that are one-way in the source."""
    need = required_directions(source, ends).where("directions != '' AND NOT contains(directions, ',')").select("unit", F.col("directions").alias("only"))
    have = required_directions(carrier, ends).select("unit", F.explode(F.split("directions", ",")).alias("direction")).where("direction != ''")
    return have.join(need, "unit").where("direction != only").select("unit", "direction")


def publish_decisions(candidates: DataFrame, overrides: DataFrame) -> DataFrame:
    """Every candidate of a missing direction in exactly one of confirmed, excluded and manual; reviews from outside win.

    ``candidates`` holds ``candidate_id, equivalent, anchor_confidence``: an equivalent carrier or an anchor that cannot be
    trusted excludes the candidate, every other one is confirmed. Only a review can ask for manual work.
    """
    other = overrides.groupBy("candidate_id").agg(F.min("status").alias("_o"))
    joined = candidates.join(other, "candidate_id", "left")
    same, weak = F.coalesce("equivalent", F.lit(False)), F.coalesce("anchor_confidence", F.lit("insufficient")) == "insufficient"
    rule = (F.when(F.col("_o").isNotNull(), "external_review_override").when(same, "equivalent_raw_carrier")
            .when(weak, "insufficient_anchor_confidence").otherwise("raw_carrier_missing_trusted_anchor"))
    return joined.select("candidate_id", F.coalesce("_o", F.when(same | weak, "excluded").otherwise("confirmed")).alias("decision"), rule.alias("rule"))


def junction_conflict_groups(hits: DataFrame) -> DataFrame:
    """Junctions that share surfaces, as groups named by their smallest member."""
    comp = conflict_components(hits.select(F.col("junction_id").alias("owner"), F.col("surface_id").alias("member")))
    sizes = comp.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return comp.join(sizes, "component", "left_semi").select(F.col("owner").alias("junction_id"), F.col("component").alias("group_id"))
