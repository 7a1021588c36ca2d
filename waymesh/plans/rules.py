"""Turn rules from restrictions, lane arrows and special roads."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..operators.arms import SECTOR_DEG, movement_cross, movement_type, sector_arms
from ..operators.spatial import points_near_lines

# Limits of the directed geometry match.
MATCH_DISTANCE_M, MATCH_ANGLE_DEG, INSIDE_DISTANCE_M = 12.0, 35.0, 15.0


def match_restrictions(restrictions: DataFrame, roads: DataFrame) -> DataFrame:
    """Roads whose line is near the start of a restriction and runs its way, with a confidence."""
    first, second = F.col("pts")[0], F.col("pts")[1]
    moving = (first["x"] != second["x"]) | (first["y"] != second["y"])
    starts = restrictions.where(moving).select("restriction_id", first["x"].alias("x"), first["y"].alias("y"),
                                               G.bearing(first, second).alias("start_deg"))
    near = points_near_lines(starts.select(F.col("restriction_id").alias("p_id"), "x", "y"),
                             roads.select(F.col("road_id").alias("line_id"), "pts"), MATCH_DISTANCE_M)
    a, b = F.col("pts")[0], F.element_at("pts", -1)
    angles = roads.where((a["x"] != b["x"]) | (a["y"] != b["y"])).select("road_id", G.bearing(a, b).alias("road_deg"))
    joined = near.select(F.col("p_id").alias("restriction_id"), F.col("line_id").alias("road_id"), "dist").join(
        angles, "road_id").join(starts.select("restriction_id", "start_deg"), "restriction_id")
    delta = G.angular_distance(F.col("start_deg"), F.col("road_deg"))
    score = F.least(F.lit(0.95), 0.55 + 0.25 * F.greatest(F.lit(0.0), 1 - F.col("dist") / MATCH_DISTANCE_M)
                    + 0.20 * F.greatest(F.lit(0.0), 1 - F.col("delta") / MATCH_ANGLE_DEG))
    return joined.withColumn("delta", delta).where(F.col("delta") <= MATCH_ANGLE_DEG).withColumn("confidence", score)


def arrow_exclusion(movements: DataFrame, arrows: DataFrame) -> DataFrame:
    """What the lane arrows of an approach road say about a movement: supported, prohibited or unknown.

    ``movements`` holds ``movement_id, road_id, movement_type``; ``arrows`` holds ``road_id, codes,
    direction_matched, sequence_complete``. Tokens are made distinct per road before they meet movements.
    """
    parsed = arrows.select("road_id", "direction_matched", "sequence_complete", F.explode(S.arrow_sequence(F.col("codes"))).alias("code")).withColumn("t", S.arrow_tokens(F.col("code")))
    usable = F.col("direction_matched") & F.col("sequence_complete") & F.col("t").isNotNull() & ~F.arrays_overlap(
        F.coalesce("t", F.array(F.lit("empty"))), F.array(F.lit("uninvestigated"), F.lit("empty")))
    state = parsed.groupBy("road_id").agg(F.bool_and(usable).alias("usable"))
    tokens = parsed.select("road_id", F.explode("t").alias("token")).groupBy("road_id").agg(F.array_sort(F.collect_set("token")).alias("tokens"))
    joined = movements.join(state, "road_id", "left").join(tokens, "road_id", "left")
    decision = (F.when(F.col("usable").isNull() | ~F.col("usable"), "unknown").when(F.array_contains("tokens", F.col("movement_type")), "supported").otherwise("prohibited"))
    return joined.select("movement_id", "road_id", "movement_type", F.coalesce(decision, F.lit("unknown")).alias("decision"), F.array_join("tokens", ",").alias("tokens"))


def special_carrier(roads: DataFrame) -> DataFrame:
    """Default support by advance-left and advance-right roads; other movements of such an arm are weakly limited.

    ``roads`` holds ``junction_id, arm_id, road_id, formway, kind, role``.
    """
    left, right = S.has_bit(F.col("formway"), S.ADVANCE_LEFT_BIT), S.has_bit(F.col("formway"), S.ADVANCE_RIGHT_BIT)
    per = roads.groupBy("junction_id", "arm_id").agg(F.count_if(left).alias("left_roads"), F.count_if(right).alias("right_roads"), F.count_if(~left & ~right).alias("core_roads"),
                                                    F.bool_or(left & right).alias("both_bits"))
    def support(n: str):
        return F.when(F.col(n) > 0, "default_support").when(F.col("left_roads") + F.col("right_roads") > 0, "weak_limit").otherwise("none")
    return per.select("junction_id", "arm_id", "left_roads", "right_roads", "core_roads", support("left_roads").alias("left"), support("right_roads").alias("right"),
                      F.when(F.col("both_bits"), "multiple_special_carrier_formway_bits").alias("risk"))


def restriction_scope(pairs: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Scope of each condition on a movement: the arms when it covers every road pair, else its road pairs.

    ``pairs`` holds ``movement_id, from_road, to_road``; ``restrictions`` holds ``condition_id, from_road, to_road``.
    """
    total = pairs.distinct().groupBy("movement_id").agg(F.count("*").alias("total"))
    hit = pairs.distinct().join(restrictions.distinct(), ["from_road", "to_road"]).groupBy("movement_id", "condition_id").agg(F.count("*").alias("covered"))
    return hit.join(total, "movement_id").select("movement_id", "condition_id", "covered", "total",
                                                 F.when(F.col("covered") == F.col("total"), "arm_to_arm").otherwise("road_pair").alias("scope"))


# Precedence of rule evidence.
EVIDENCE_ORDER = ("restriction", "laneinfo", "special_carrier")


def decide_rules(evidence: DataFrame) -> DataFrame:
    """Decision of each movement on a road by the strongest evidence, and what it overrides.

    ``evidence`` holds ``movement_id, road_id, source, decision``; unknown lane arrows decide nothing.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in EVIDENCE_ORDER]), F.col("source"))
    known = evidence.where(F.col("decision") != "unknown").groupBy("movement_id", "road_id", "source").agg(F.min(F.struct("decision"))["decision"].alias("decision")).withColumn("rank", rank)
    chain = known.groupBy("movement_id", "road_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "decision"))).alias("c"))
    decided = chain.select("movement_id", "road_id", F.col("c")[0]["decision"].alias("decision"), F.col("c")[0]["source"].alias("source"),
                           F.array_join(F.transform(F.slice(F.col("c"), 2, 3), lambda x: F.concat(x["source"], F.lit(":"), x["decision"])), ",").alias("overrides"))
    every = evidence.select("movement_id", "road_id").distinct()
    return every.join(decided, ["movement_id", "road_id"], "left").select("movement_id", "road_id", F.coalesce("decision", F.lit("unknown")).alias("decision"), "source", F.coalesce("overrides", F.lit("")).alias("overrides"))


def project_rules(rules: DataFrame, segment_map: DataFrame) -> DataFrame:
    """Rules carried over to the fused network: stable when both roads map to one final road, else candidates.

    ``rules`` holds ``rule_id, from_road, to_road``; ``segment_map`` holds ``road_id, final_road``.
    """
    per = segment_map.groupBy("road_id").agg(F.count_distinct("final_road").alias("n"), F.min("final_road").alias("final_road"))
    a = per.select(F.col("road_id").alias("from_road"), F.col("n").alias("_fn"), F.col("final_road").alias("final_from"))
    b = per.select(F.col("road_id").alias("to_road"), F.col("n").alias("_tn"), F.col("final_road").alias("final_to"))
    joined = rules.join(a, "from_road", "left").join(b, "to_road", "left")
    state = (F.when(F.col("_fn").isNull() | F.col("_tn").isNull(), "unmapped").when((F.col("_fn") == 1) & (F.col("_tn") == 1), "stable").otherwise("candidate"))
    return joined.select("rule_id", "final_from", "final_to", state.alias("state"))


def restore_rules_v1(movements: DataFrame, restrictions: DataFrame) -> DataFrame:
    """Restriction-only strategy: a movement is prohibited when a restriction names one of its road pairs.

    ``movements`` holds ``movement_id, from_road, to_road, applicable``.
    """
    named = restrictions.select("from_road", "to_road").distinct().withColumn("_r", F.lit(True))
    per = movements.join(named, ["from_road", "to_road"], "left").groupBy("movement_id").agg(F.bool_and("applicable").alias("ok"), F.count("*").alias("pairs"), F.count("_r").alias("restricted_pairs"))
    status = F.when(~F.col("ok"), "not_a_traffic_rule").when(F.col("restricted_pairs") == 0, "no_prohibition_evidence").when(F.col("restricted_pairs") == F.col("pairs"), "prohibited").otherwise("partially_prohibited")
    return per.select("movement_id", "pairs", "restricted_pairs", status.alias("status"))


def build_movements(ends: DataFrame) -> DataFrame:
    """Arm movements of each junction with their type from the mean travel directions of the arms.

    Arms are 15 degree sectors, so a junction has at most 24 of them whatever its number of roads.
    """
    arms = sector_arms(ends)
    pairs = movement_cross(arms)
    width = float(SECTOR_DEG)
    from_deg, to_deg = F.radians((F.col("from_sector") + 0.5) * width), F.radians((F.col("to_sector") + 0.5) * width)
    kind = movement_type(-F.cos(from_deg), -F.sin(from_deg), F.cos(to_deg), F.sin(to_deg), F.col("from_sector") == F.col("to_sector"))
    return pairs.select("junction_id", "from_sector", "to_sector", (F.col("roads_in") * F.col("roads_out")).alias("road_pairs"), kind.alias("movement_type"))
