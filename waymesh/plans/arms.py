"""Arms of several networks at the same junction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import angular_distance, circular_mean
from ..functions.scalar import confidence
from ..lineage import cut
from ..operators.arms import SECTOR_DEG, movement_cross
from ..operators.assignment import exclusive_assignment
from ..operators.topk import margin_to_second


def dataset_arm_pairs(ends: DataFrame, sector_deg: int = SECTOR_DEG) -> DataFrame:
    """Arm pairs of a junction over every two datasets; arms are sectors, so pairs stay few per junction."""
    sector = F.floor(F.col("angle") / sector_deg).cast("int")
    arms = ends.where(F.col("angle").isNotNull()).select("junction_id", "dataset", sector.alias("sector")).distinct()
    left = arms.select("junction_id", F.col("dataset").alias("left_set"), F.col("sector").alias("left_sector"))
    right = arms.select("junction_id", F.col("dataset").alias("right_set"), F.col("sector").alias("right_sector"))
    return left.join(right, "junction_id").where(F.col("left_set") < F.col("right_set"))


def arm_profiles(ends: DataFrame) -> DataFrame:
    """Arms of each dataset at a junction: 30 degree sectors with roles, mean direction and number of roads."""
    sector = F.floor(F.col("angle") / 30).cast("int")
    return ends.where(F.col("angle").isNotNull()).groupBy("junction_id", "dataset", sector.alias("arm")).agg(
        F.count("*").alias("roads"), F.bool_or(F.col("role").isin("inbound", "bidirectional")).alias("has_in"),
        F.bool_or(F.col("role").isin("outbound", "bidirectional")).alias("has_out"), circular_mean(F.col("angle")).alias("trend"))


def _role(has_in, has_out):
    return F.when(has_in & has_out, "bidirectional").when(has_in, "inbound").when(has_out, "outbound")


# Points of the arm match by roles, trend, terminal and road coverage.
def arm_scores(profiles: DataFrame, left_set: int, right_set: int) -> DataFrame:
    """Match score of every arm pair of two datasets at a junction; at most 12 arms each."""
    cols = ["arm", "roads", "has_in", "has_out", "trend"]
    a = profiles.where(F.col("dataset") == left_set).select("junction_id", *[F.col(c).alias(f"l_{c}") for c in cols])
    b = profiles.where(F.col("dataset") == right_set).select("junction_id", *[F.col(c).alias(f"r_{c}") for c in cols])
    pairs = a.join(b, "junction_id")
    lr, rr = _role(F.col("l_has_in"), F.col("l_has_out")), _role(F.col("r_has_in"), F.col("r_has_out"))
    role = (F.when(lr.isNull() | rr.isNull(), 10.0).when(lr == rr, 25.0).when((lr == "bidirectional") | (rr == "bidirectional"), 22.0).otherwise(18.0))
    delta = F.round(angular_distance(F.col("l_trend"), F.col("r_trend")), 6)
    trend = F.when(delta <= 20, 25.0).when(delta <= 45, 18.0).when(delta <= 90, 10.0).otherwise(4.0)
    ratio = F.least("l_roads", "r_roads") / F.greatest("l_roads", "r_roads")
    cover = F.when(ratio >= 0.65, 20.0).when(ratio >= 0.35, 14.0).otherwise(8.0)
    geometry = F.round(15.0 * (1 - F.least(delta, F.lit(90.0)) / 90.0), 2)
    terminal = F.lit(10.0)
    return pairs.select("junction_id", F.col("l_arm").alias("left_arm"), F.col("r_arm").alias("right_arm"),
                        (role + trend + terminal + cover + geometry).alias("score"), (role + trend + terminal + cover).alias("non_geometry"), (ratio < 0.65).alias("partial"))


def assign_arms(scores: DataFrame, min_score: float = 40.0) -> DataFrame:
    """One-to-one arm matches per junction among pairs that are not rejected."""
    usable = scores.where(F.col("score") >= min_score)
    return exclusive_assignment(usable.select(F.col("junction_id").alias("unit"), F.col("left_arm").alias("left"), F.col("right_arm").alias("right"), "score"))


# Least score of a candidate that may stand beside the best one, and how far below it.
SELECT_SCORE, SELECT_MARGIN = 60.0, 20.0


def select_arms(scores: DataFrame, min_score: float = 40.0) -> DataFrame:
    """Right arms that stand for each left arm: the best one and good ones close below it, except those another left arm is given.

    Left arms with good candidates share them out one to one first; what stays free may join them. One without a share
    keeps its candidates, so a right arm may stand for several.
    """
    pair = F.struct("right_arm", "score", "non_geometry", "partial")
    pools = scores.where(F.col("score") >= min_score).groupBy("junction_id", "left_arm").agg(
        F.max(F.struct("score", (-F.col("right_arm")).alias("o"))).alias("top"), F.collect_list(pair).alias("pool"))
    rows = pools.select("junction_id", "left_arm", "top", F.inline("pool"))
    close = (F.col("score") >= SELECT_SCORE) & (F.round(F.col("top.score") - F.col("score"), 6) <= SELECT_MARGIN)
    chosen = cut(rows.where(close | ((F.col("top.score") < SELECT_SCORE) & (F.col("right_arm") == -F.col("top.o")))).drop("top"))
    shares = cut(assign_arms(chosen, SELECT_SCORE))
    own = shares.select(F.col("unit").alias("junction_id"), F.col("left").alias("left_arm"), F.col("right").alias("_own"))
    taken = shares.select(F.col("unit").alias("junction_id"), F.col("right").alias("right_arm"), F.lit(True).alias("_taken"))
    joined = chosen.join(own, ["junction_id", "left_arm"], "left").join(taken, ["junction_id", "right_arm"], "left")
    return joined.where(F.col("_own").isNull() | (F.col("_own") == F.col("right_arm")) | F.col("_taken").isNull()).drop("_own", "_taken")


def logical_groups(profiles: DataFrame, scores: DataFrame) -> DataFrame:
    """Right arms, match type, coverage and confidence of every left arm."""
    left = profiles.where("dataset = 0").select("junction_id", F.col("arm").alias("left_arm"))
    kept = select_arms(scores)
    users = kept.groupBy("junction_id", "right_arm").agg(F.count("*").alias("users"))
    level = confidence(F.col("score"), F.lit(False), F.col("non_geometry"))
    rank = F.when(level == "high", 3).when(level == "medium", 2).otherwise(1)
    groups = kept.join(users, ["junction_id", "right_arm"]).groupBy("junction_id", "left_arm").agg(
        F.sort_array(F.collect_list("right_arm")).alias("right_arms"), F.max("users").alias("users"), F.bool_or("partial").alias("partial"), F.max(rank).alias("rank"))
    many, shared = F.size("right_arms") > 1, F.col("users") > 1
    missing = F.col("right_arms").isNull()
    uncertain = ~many & ~shared & ~F.col("partial") & (F.col("rank") == 1)
    match = (F.when(missing, "missing").when(uncertain, "uncertain").when(many & shared, "many_to_many").when(many, "one_to_many")
             .when(shared, "many_to_one").otherwise("one_to_one"))
    coverage = (F.when(missing, "none").when(F.col("partial"), "partial").when(many, "over_split").when(shared, "over_merged").when(uncertain, "unknown").otherwise("full"))
    return left.join(groups, ["junction_id", "left_arm"], "left").select(
        "junction_id", "left_arm", "right_arms", match.alias("match_type"), coverage.alias("coverage"),
        F.when(missing, "missing").otherwise(F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("rank"))).alias("confidence"))


def generate_road_next_road(source_pairs: DataFrame, mapping: DataFrame) -> DataFrame:
    """Allowed road pairs of the source carried to the target through road roles, copies dropped.

    ``source_pairs`` holds ``from_road, to_road``; ``mapping`` holds ``road_id, target_road, role``.
    """
    entry = mapping.where(F.col("role").isin("approach", "both")).select(F.col("road_id").alias("from_road"), F.col("target_road").alias("target_from"))
    leave = mapping.where(F.col("role").isin("exit", "both")).select(F.col("road_id").alias("to_road"), F.col("target_road").alias("target_to"))
    return source_pairs.distinct().join(entry, "from_road").join(leave, "to_road").where("target_from != target_to").select("target_from", "target_to").distinct()


def advance_right_relations(roads: DataFrame, ends: DataFrame) -> DataFrame:
    """Arms that each special turn road leads from and to: the sectors of its junctions it touches.

    ``ends`` holds ``junction_id, id, role, angle``.
    """
    special = roads.where((F.col("formway").bitwiseAND(128 | 256)) != 0).select("id", F.when(F.col("formway").bitwiseAND(128) != 0, "right").otherwise("left").alias("turn"))
    sector = F.floor(F.col("angle") / SECTOR_DEG).cast("int")
    placed = ends.join(special, "id").where(F.col("angle").isNotNull())
    source = placed.where(F.col("role").isin("outbound", "bidirectional")).groupBy("id", "turn").agg(F.min(F.struct("junction_id", sector.alias("s"))).alias("f"))
    target = placed.where(F.col("role").isin("inbound", "bidirectional")).groupBy("id").agg(F.max(F.struct("junction_id", sector.alias("s"))).alias("t"))
    return source.join(target, "id").select("id", "turn", F.col("f.junction_id").alias("from_junction"), F.col("f.s").alias("from_sector"), F.col("t.junction_id").alias("to_junction"), F.col("t.s").alias("to_sector"))


def movement_evidence(arms: DataFrame, margin_deg: float = 5.0) -> DataFrame:
    """Straight target of every entering arm: the arm nearest to straight on, when clear by a margin.

    Arms are sectors, at most 24 per junction.
    """
    pairs = movement_cross(arms)
    turn = F.abs((F.col("to_sector") - F.col("from_sector")) * float(SECTOR_DEG) - 180.0) % 360
    off = F.least(turn, 360 - turn)
    best = margin_to_second(pairs.where("to_sector != from_sector").withColumn("off", off), ["junction_id", "from_sector"], "off", "to_sector")
    clear = F.col("margin").isNull() | (F.col("margin") >= margin_deg)
    return best.select("junction_id", "from_sector", F.when(clear, F.col("best_id")).alias("straight_sector"), F.col("best_score").alias("off_deg"), F.when(clear, "unique").otherwise("ambiguous").alias("state"))


def receiving_roles(pairs: DataFrame) -> DataFrame:
    """Role of every receiving road from the turns that lead into it."""
    per = pairs.groupBy("to_road").agg(F.count("*").alias("feeders"), F.bool_or(F.col("movement_type") == "straight").alias("s"), F.bool_or(F.col("movement_type") == "left").alias("l"),
                                       F.bool_or(F.col("movement_type") == "right").alias("r"))
    role = F.when(F.col("s"), "main_receiving").when(F.col("l") & F.col("r"), "mixed_turn_receiving").when(F.col("l"), "left_receiving").when(F.col("r"), "right_receiving").otherwise("unknown")
    return per.select("to_road", "feeders", role.alias("role"))
