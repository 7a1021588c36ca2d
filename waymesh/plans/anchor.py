"""Anchoring of junctions on surfaces and publication of relations."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.graph import conflict_components, unit_components
from ..operators.ordered import with_running_sum
from .quality import required_directions


def funnel(states: DataFrame, *keys: str) -> DataFrame:
    """How many semantic junctions reach each stage, over all or per source.

    ``states`` has one row per junction: ``semantic, has_evidence, status, consumable``.
    """
    success = F.col("status") == 0
    return states.where("semantic").groupBy(*keys).agg(
        F.count("*").alias("semantic_total"), F.count_if("has_evidence").alias("evidence_total"),
        F.count("status").alias("published_total"), F.count_if(success).alias("success_total"),
        F.count_if(F.col("status") == 1).alias("failure_total"), F.count_if(success & F.col("consumable")).alias("consumable_total"),
        F.count_if(success & ~F.col("consumable")).alias("unconsumable_total"))


def graph_consumability(relations: DataFrame, nodes: DataFrame, roads: DataFrame) -> DataFrame:
    """Whether the base of each relation exists, alone or as a group, and has roads."""
    ends = roads.select(F.explode(F.array("snodeid", "enodeid")).alias("id")).distinct().withColumn("_inc", F.lit(True))
    exists = nodes.select(F.col("id").alias("base_id"), F.lit(True).alias("_node"))
    base_ends = ends.select(F.col("id").alias("base_id"), F.lit(True).alias("_own"))
    named = nodes.where(F.col("mainnodeid").isNotNull() & ~F.col("mainnodeid").isin(0, -1))
    group = named.join(ends, "id", "left").groupBy(F.col("mainnodeid").alias("base_id")).agg(
        F.bool_or(F.coalesce("_inc", F.lit(False))).alias("_grp"))
    joined = relations.join(exists, "base_id", "left").join(base_ends, "base_id", "left").join(group, "base_id", "left")
    node, own, any_incident = F.col("_node").isNotNull(), F.col("_own").isNotNull(), F.coalesce("_grp", F.lit(False))
    state = (F.when(F.col("status") != 0, "relation_not_success")
             .when(F.col("base_id").isNull() | (F.col("base_id") <= 0), "success_relation_missing_base_id")
             .when(node & own, "base_node_graph_incident").when(node & any_incident, "base_node_group_graph_incident")
             .when(node, "base_node_not_incident_to_rcsdroad").when(any_incident, "base_mainnodeid_graph_incident")
             .when(F.col("_grp").isNotNull(), "base_mainnodeid_not_incident_to_rcsdroad")
             .otherwise("base_id_not_found_in_rcsdnode_out"))
    return joined.select("target_id", "base_id", "status", state.alias("state"), state.endswith("graph_incident").alias("consumable"))


ALLOWED_KINDS = (1, 4, 8, 16, 64, 128, 2048)


def anchor_states(groups: DataFrame, hits: DataFrame) -> DataFrame:
    """Anchor state of every junction: null, no, yes, fail1 or fail2.

    ``groups`` holds ``junction_id, kind_2, has_evd, members``; ``hits`` holds ``junction_id, surface_id``.
    """
    pairs = hits.select("junction_id", "surface_id").distinct()
    usable = groups.where((F.col("has_evd") == "yes") & F.col("kind_2").isin(*ALLOWED_KINDS))
    live = pairs.join(usable.select("junction_id", "kind_2"), "junction_id")
    shared = live.where(F.col("kind_2") != 1).groupBy("surface_id").agg(F.count("*").alias("n")).where("n > 1").select("surface_id")
    fail2 = live.where(F.col("kind_2") != 1).join(shared, "surface_id", "left_semi").select("junction_id").distinct()
    counts = pairs.groupBy("junction_id").agg(F.count("*").alias("surfaces"))
    joined = groups.join(counts, "junction_id", "left").join(fail2.withColumn("_f2", F.lit(True)), "junction_id", "left")
    takes_part = (F.col("has_evd") == "yes") & F.col("kind_2").isin(*ALLOWED_KINDS)
    n = F.coalesce("surfaces", F.lit(0))
    state = (F.when(~F.coalesce(takes_part, F.lit(False)), None).when(F.col("_f2"), "fail2").when(F.col("kind_2").isin(64, 128), "no")
             .when(n == 0, "no").when((n == 1) | (F.col("members") == 1), "yes").otherwise("fail1"))
    return joined.select("junction_id", "kind_2", n.alias("surfaces"), state.alias("is_anchor"))


def surfaces_with_carrier(hits: DataFrame, carrier_hits: DataFrame) -> DataFrame:
    """Junction hits on surfaces that hold a carrier junction."""
    return hits.join(carrier_hits.select("surface_id").distinct(), "surface_id", "left_semi")


def supplement_relations(published: DataFrame, external: DataFrame, base_ids: DataFrame) -> DataFrame:
    """Published successes plus external successes for other targets whose base exists, first per target."""
    good = published.where("status = 0 AND base_id > 0").select("target_id", "base_id", F.lit(0).alias("priority"))
    extra = external.where("status = 0 AND base_id > 0").join(base_ids.select("base_id").distinct(), "base_id", "left_semi").select(
        "target_id", "base_id", F.lit(1).alias("priority"))
    both = good.unionByName(extra)
    return both.groupBy("target_id").agg(F.min(F.struct("priority", "base_id")).alias("b")).select(
        "target_id", "b.base_id", F.when(F.col("b.priority") == 0, "published").otherwise("supplement").alias("source"))


def virtual_candidates(states: DataFrame) -> DataFrame:
    """Junctions with evidence but no anchor, by the virtual method that serves their kind."""
    wanted = (F.col("has_evd") == "yes") & (F.col("is_anchor") == "no")
    method = F.when(F.col("kind_2").isin(4, 2048), "virtual_junction").when(F.col("kind_2").isin(8, 16, 128), "divmerge")
    return states.where(wanted & method.isNotNull()).select("junction_id", "kind_2", method.alias("method"))


def junction_template(kind_2):
    return F.when(kind_2 == 4, "center_junction").when(kind_2 == 2048, "single_sided_t_mouth")


def association_class(evidence: DataFrame, anchor_m: float = 8.0, pair_m: float = 15.0) -> DataFrame:
    """Class of a junction's carrier evidence: A with a required core, B with support only, C with none.

    ``evidence`` holds ``junction_id, template, group_id, dist_m, compact, degree, is_required``.
    """
    near = F.col("is_required") & (F.col("dist_m") <= anchor_m)
    pair = F.col("is_required") & (F.col("dist_m") <= pair_m)
    summary = evidence.groupBy("junction_id", "template").agg(
        F.count_if("is_required").alias("required"), F.count_if(near).alias("near"), F.count_if(pair).alias("paired"),
        F.count_if(F.col("is_required") & F.col("compact") & (F.col("degree") >= 3)).alias("compact"), F.count_if(~F.col("is_required")).alias("support"))
    center = (F.col("template") == "center_junction") & ((F.col("near") > 0) | (F.col("paired") >= 2) | (F.col("compact") > 0))
    side = (F.col("template") == "single_sided_t_mouth") & ((F.col("required") >= 2) | (F.col("near") > 0) | (F.col("compact") > 0))
    core = (F.col("required") > 0) & (center | side)
    cls = F.when(core, "A").when(F.col("support") + F.col("required") > 0, "B").otherwise("C")
    reason = (F.when(core, "required_core_retained").when(F.col("required") > 0, "required_core_dropped")
              .when(F.col("support") > 0, "association_support_only").otherwise("no_related_carrier"))
    return summary.select("junction_id", "template", cls.alias("association_class"), reason.alias("reason"))


def axis_clusters(angles: DataFrame, tolerance_deg: float) -> DataFrame:
    """Clusters of axis directions (mod 180) per junction and side; neighbours within the tolerance chain up.

    Directions are reduced to whole degrees first, so one junction side never has more than 180 rows.
    """
    axes = angles.select("junction_id", "side", (F.round("angle") % 180).cast("int").alias("axis")).groupBy("junction_id", "side", "axis").agg(F.count("*").alias("n"))
    order = Window.partitionBy("junction_id", "side").orderBy("axis")
    step = F.when(F.col("axis") - F.lag("axis").over(order) > tolerance_deg, 1).otherwise(0)
    numbered = axes.withColumn("_s", step).withColumn("cluster", F.sum("_s").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ends = numbered.groupBy("junction_id", "side").agg(F.min("axis").alias("lo"), F.max("axis").alias("hi"), F.max("cluster").alias("last"))
    joined = numbered.join(ends, ["junction_id", "side"])
    wraps = (F.col("lo") + 180 - F.col("hi") <= tolerance_deg) & (F.col("last") > 0) & (F.col("cluster") == F.col("last"))
    merged = joined.withColumn("cluster", F.when(wraps, 0).otherwise(F.col("cluster")))
    twice = F.radians(F.col("axis") * 2.0)
    mean = F.degrees(F.atan2(F.sum(F.sin(twice) * F.col("n")), F.sum(F.cos(twice) * F.col("n")))) / 2
    return merged.groupBy("junction_id", "side", "cluster").agg(mean.alias("mean"), F.sum("n").alias("n")).withColumn(
        "mean", F.when(F.col("mean") < 0, F.col("mean") + 180).otherwise(F.col("mean")))


def direction_gate(clusters: DataFrame, tolerance_deg: float) -> DataFrame:
    """Whether enough source directions have a carrier direction close by; clusters are few per junction."""
    selected = clusters.where("side = 0").select("junction_id", "cluster", F.col("mean").alias("m0"))
    carrier = clusters.where("side = 1").select("junction_id", F.col("mean").alias("m1"))
    diff = F.abs(F.col("m0") - F.col("m1"))
    hit = F.coalesce(F.least(diff, 180 - diff) <= tolerance_deg, F.lit(False))
    matched = selected.join(carrier, "junction_id", "left").groupBy("junction_id", "cluster").agg(F.bool_or(hit).alias("hit"))
    per = matched.groupBy("junction_id").agg(F.count("*").alias("selected_clusters"), F.count_if("hit").alias("matched_clusters"))
    return per.withColumn("passed", F.col("matched_clusters") >= F.least(F.lit(2), F.col("selected_clusters")))


def topology_guard(edges: DataFrame, ends: DataFrame, directed: DataFrame) -> DataFrame:
    """Reasons against a case's raw carrier support: collapsed ends, several parts, no way between the ends.

    ``edges`` and ``directed`` hold ``unit, src, dst, road_id``; ``ends`` holds ``unit, a, b``.
    """
    comp = unit_components(edges)
    parts = comp.groupBy("unit").agg(F.count_distinct("component").alias("parts"))
    roads = edges.groupBy("unit").agg(F.count("*").alias("roads"))
    ways = required_directions(directed, ends).select("unit", "directions")
    joined = ends.join(parts, "unit", "left").join(roads, "unit", "left").join(ways, "unit", "left")
    reasons = F.concat_ws("|", F.when(F.col("a") == F.col("b"), "terminal_collapse"), F.when(F.col("parts") > 1, "multi_component_support"),
                          F.when(F.coalesce("directions", F.lit("")) == "", "directional_mismatch"), F.when(F.col("roads").isNull(), "no_support"))
    return joined.select("unit", reasons.alias("reasons"), (reasons == "").alias("passed"))


def foreign_objects(candidates: DataFrame, owners: DataFrame) -> DataFrame:
    """Candidate carriers that some other junction owns.

    ``candidates`` holds ``junction_id, carrier_id``; ``owners`` holds ``junction_id, carrier_id``.
    """
    claim = owners.groupBy("carrier_id").agg(F.min("junction_id").alias("lo"), F.max("junction_id").alias("hi"))
    foreign = (F.col("lo") != F.col("junction_id")) | (F.col("hi") != F.col("junction_id"))
    return candidates.join(claim, "carrier_id").where(foreign).select("junction_id", "carrier_id")


# Weights of the divmerge candidate score.
TREND_W, ROLE_W, REFERENCE_W, CROSS_W, CLOSER_W = 0.30, 0.25, 0.25, -0.10, -0.10


def divmerge_score(support, consistency, trend, has_reference, cross_penalty, closer_penalty):
    """Weighted score of a divmerge candidate from its evidence columns."""
    role = (F.when(support == "primary_support", 1.0).when(support == "secondary_support", 0.65).otherwise(0.0)
            + F.when(consistency == "A", 1.0).when(consistency == "B", 0.65).when(consistency == "C", 0.15).otherwise(-0.15)) / 2
    reference = F.when(has_reference, 1.0).otherwise(0.35)
    return TREND_W * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), trend)) + ROLE_W * role + REFERENCE_W * reference + CROSS_W * cross_penalty + CLOSER_W * closer_penalty


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """Cases that claim the same carrier, by group of connected claims, with the case that keeps each carrier.

    ``claims`` holds ``case_id, carrier_id, score``; the highest score wins, then the smaller case.
    """
    best = claims.groupBy("carrier_id").agg(F.count("*").alias("claimants"), F.min(F.struct((-F.col("score")).alias("s"), "case_id")).alias("w"))
    contested = claims.join(best.where("claimants > 1"), "carrier_id")
    groups = conflict_components(contested.select(F.col("carrier_id").alias("member"), F.col("case_id").alias("owner")))
    return contested.join(groups.withColumnRenamed("owner", "case_id"), "case_id").select(
        "case_id", "carrier_id", "component", (F.col("w.case_id") == F.col("case_id")).alias("keeps"))


def event_units(arms: DataFrame) -> DataFrame:
    """Adjacent branch pairs of complex junctions around the circle; arms are sectors, at most 24 per junction."""
    order = Window.partitionBy("junction_id").orderBy("sector")
    first = F.min("sector").over(Window.partitionBy("junction_id"))
    following = F.coalesce(F.lead("sector").over(order), first)
    n = F.count("*").over(Window.partitionBy("junction_id"))
    paired = arms.select("junction_id", "sector", following.alias("next_sector"), n.alias("branches"), F.row_number().over(order).alias("unit_no"))
    return paired.where((F.col("branches") >= 3) | ((F.col("branches") == 2) & (F.col("unit_no") == 1)))


def accept_reject(cases: DataFrame) -> DataFrame:
    """Final state of a virtual junction with reason and review class."""
    blocked = F.col("association_state") == "not_established"
    state = F.when(blocked | ~F.col("geometry_ok"), "rejected").otherwise("accepted")
    reason = (F.when(blocked, "step7_blocked_by_association").when(~F.col("geometry_ok"), "step7_rejected_after_step6_failure")
              .when(F.col("upstream_review"), "step7_accepted_with_upstream_step3_visual_risk").when(F.col("signals") > 0, "step7_accepted_with_visual_risk")
              .when(F.col("support_only"), "step7_accepted_after_support_only_convergence").otherwise("step7_accepted"))
    visual = (F.when(blocked, "V5").when(~F.col("geometry_ok"), F.when(F.col("cause") == "stage3_rc_gap", "V3").when(F.col("cause").contains("foreign"), "V4").otherwise("V5"))
              .when(F.col("upstream_review") | (F.col("signals") > 0), "V2").otherwise("V1"))
    return cases.select("case_id", state.alias("state"), reason.alias("reason"), visual.alias("visual_class"))


def scene_decision(evidence: DataFrame) -> DataFrame:
    """Scene of an evidence row: direct, group_existing, road_split, no_rcsd or failure.

    ``evidence`` holds ``source, relation_state, status_suggested, base_count, required_count, selected_count,
    road_count, junction_type, manual_type`` besides its keys.
    """
    src, state = F.col("source"), F.col("relation_state")
    ready = (F.col("base_count") > 0) & (F.col("status_suggested") == "0")
    manual = (F.when(F.col("base_count") == 0, "failure").when(F.col("manual_type") == "1v1_rcsd_junction", "direct")
              .when(F.col("manual_type") == "1vN_rcsd_junction", "group_existing").when(F.col("manual_type").endswith("_rcsd_road"), "road_split").otherwise("failure"))
    scene = (F.when(src == "T11_MANUAL", manual)
             .when(src == "T02_INPUT", F.when((state == "existing_rcsdintersection_matched") & (F.col("base_count") > 0), "direct").otherwise("failure"))
             .when((src == "T07") & (state == "multiple_intersections_for_group"), F.when(F.col("base_count") > 1, "group_existing").otherwise("failure"))
             .when((src == "T07") & (state == "existing_rcsdintersection_matched") & (F.col("status_suggested") == "0"), "direct")
             .when(ready, "direct").when(F.col("required_count") == 1, "direct").when(F.col("required_count") > 1, "group_existing")
             .when((src == "T04") & (F.col("junction_type") == "complex_divmerge") & (F.col("selected_count") > 1), "group_existing")
             .when((state == "rcsd_present_not_junction") & (F.col("road_count") > 0), "road_split").when(state == "no_related_rcsd", "no_rcsd").otherwise("failure"))
    return evidence.withColumn("scene", scene)


# Precedence of scenes and sources when one target has several decisions.
SCENE_ORDER = ("direct", "group_existing", "road_split", "no_rcsd", "failure")
DECISION_SOURCES = ("T11_MANUAL", "T07", "T03", "T04", "T02_INPUT")


def publish_relations(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """Exactly one relation row per target: success on an actionable scene, else failure with base 0.

    ``decisions`` holds ``target_id, source, scene, base_id``.
    """
    manual_first = F.when((F.col("source") == "T11_MANUAL") & F.col("scene").isin("direct", "group_existing", "road_split"), 0).otherwise(1)
    scene_no = F.array_position(F.array(*[F.lit(s) for s in SCENE_ORDER]), F.col("scene"))
    source_no = F.array_position(F.array(*[F.lit(s) for s in DECISION_SOURCES]), F.col("source"))
    best = decisions.groupBy("target_id").agg(F.min(F.struct(manual_first.alias("m"), scene_no.alias("n"), source_no.alias("s"), "base_id", "scene", "source")).alias("d"))
    joined = targets.select("target_id").join(best, "target_id", "left")
    ok = F.coalesce(F.col("d.scene").isin("direct", "group_existing", "road_split") & (F.col("d.base_id") > 0), F.lit(False))
    return joined.select("target_id", F.when(ok, F.col("d.base_id")).otherwise(0).alias("base_id"), F.when(ok, 0).otherwise(1).alias("status"),
                         F.coalesce("d.scene", F.lit("missing_evidence")).alias("scene"), "d.source")


def group_nodes(members: DataFrame) -> DataFrame:
    """Main node of every carrier group: the member nearest to the target, smaller id on ties.

    ``members`` holds ``target_id, node_id, dist_m``. Groups of one stay without a main node.
    """
    primary = members.groupBy("target_id").agg(F.min(F.struct("dist_m", "node_id"))["node_id"].alias("primary_id"), F.count("*").alias("n"))
    return members.select("target_id", "node_id").join(primary, "target_id").select(
        "target_id", "node_id", F.when(F.col("n") > 1, F.col("primary_id")).alias("mainnodeid"))


def split_roads(roads: DataFrame, points: DataFrame, first_new_id: int, min_gap: float = 3.0, end_gap: float = 1.0) -> DataFrame:
    """Cut roads at projected points; pieces get new ids in road order, inner ends get new node ids.

    ``roads`` holds ``road_id, snodeid, enodeid, pts``; ``points`` holds ``road_id, x, y``, a handful per road.
    Numbers come from a two-level running sum, so numbering is spread over tasks.
    """
    cuts = points.join(roads.select("road_id", "pts"), "road_id").groupBy("road_id").agg(
        F.collect_set(G.project(F.struct("x", "y"), F.col("pts"))["measure"]).alias("raw"))
    cut_roads = roads.join(cuts, "road_id").select("*", G.normalized_cuts(F.col("raw"), G.length(F.col("pts")), min_gap, end_gap).alias("cuts"))
    usable = cut_roads.where(F.size("cuts") > 0).withColumn("_n", F.size("cuts"))
    numbered = with_running_sum(usable.withColumn("_all", F.lit(1)), "_all", ["road_id"], F.col("_n"), "_upto", 100_000)
    base = F.col("_upto") - F.col("_n")
    road_base = with_running_sum(numbered.withColumn("_base", base), "_all", ["road_id"], F.col("_n") + 1, "_roads", 100_000).withColumn(
        "_rbase", F.col("_roads") - F.col("_n") - 1)
    pieces = road_base.select("road_id", "snodeid", "enodeid", "_base", "_rbase", "_n", F.posexplode(G.split_at(F.col("pts"), F.col("cuts"))).alias("i", "line"))
    return pieces.select(
        F.col("road_id").alias("source_road_id"), (F.lit(first_new_id) + F.col("_rbase") + F.col("i")).alias("road_id"),
        F.when(F.col("i") == 0, F.col("snodeid")).otherwise(F.lit(first_new_id) + F.col("_base") + F.col("i") - 1).alias("snodeid"),
        F.when(F.col("i") == F.col("_n"), F.col("enodeid")).otherwise(F.lit(first_new_id) + F.col("_base") + F.col("i")).alias("enodeid"), F.col("line").alias("pts"))


def aggregate_roundabouts(ring_nodes: DataFrame, hits: DataFrame, carriers: DataFrame) -> DataFrame:
    """Roundabouts with the surfaces their nodes lie in and the carrier junctions on those surfaces.

    ``ring_nodes`` holds ``node, mainnodeid``; ``hits`` holds ``surface_id, node``; ``carriers`` holds ``surface_id, carrier_id``.
    """
    surfaces = ring_nodes.join(hits, "node").select("mainnodeid", "surface_id").distinct()
    found = surfaces.join(carriers, "surface_id", "left").select("mainnodeid", "surface_id", "carrier_id").distinct()
    return found.groupBy("mainnodeid").agg(F.count_distinct("surface_id").alias("surfaces"), F.count_distinct("carrier_id").alias("carriers"),
                                           F.min("carrier_id").alias("main_carrier_id"))


def backfill_evidence(rows: DataFrame, cases: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fill empty evidence fields from case records."""
    other = cases.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(other, key, "left")
    filled = F.lit(False)
    for f in fields:
        filled = filled | (F.col(f).isNull() & F.col(f"_{f}").isNotNull())
    return joined.select(key, *[F.coalesce(f, f"_{f}").alias(f) for f in fields], filled.alias("backfilled"))
