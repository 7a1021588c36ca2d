"""Replacement of source segments by carrier roads."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..lineage import cut
from ..operators.graph import (both_ways, conflict_components, connected_components, directed_edges, flatten_aliases, pairs_reachable,
                               prune_leaves, shortest_distances, trace_back, unit_components)
from ..operators.laneways import corridor_shares
from ..operators.spatial import around_homes, homes, points_near_lines, salted_cells
from .quality import required_directions


def union_tagged(retained: DataFrame, selected: DataFrame) -> DataFrame:
    """Retained source rows and selected carrier rows in one frame with their origin."""
    return retained.withColumn("source", F.lit("source")).unionByName(
        selected.withColumn("source", F.lit("carrier")), allowMissingColumns=True)


def bridge_components(unreplaced: DataFrame, replaced: DataFrame) -> DataFrame:
    """Components of unreplaced roads that touch at least two replaced segments."""
    comp = connected_components(unreplaced)
    boundary = replaced.select("segment_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    return comp.join(boundary, "node").groupBy("component").agg(F.count_distinct("segment_id").alias("segments")).where("segments >= 2")


def fusion_units(segment_nodes: DataFrame, node_states: DataFrame, overrides: DataFrame) -> DataFrame:
    """Candidate and final segments with the reject stage and reason.

    ``segment_nodes`` holds ``segment_id, pos, role, node_id``; ``node_states`` holds ``node_id, has_evd,
    is_anchor, kind_2``; nodes in ``overrides`` count as confirmed by hand. Inner junctions of plain kind
    are left out when they lack evidence; every other node must have it.
    """
    manual = overrides.select("node_id").distinct().withColumn("_manual", F.lit(True))
    rows = segment_nodes.join(node_states, "node_id", "left").join(manual, "node_id", "left")
    by_hand = F.coalesce("_manual", F.lit(False))
    evd, anchor = F.lower(F.coalesce("has_evd", F.lit(""))), F.lower(F.coalesce("is_anchor", F.lit("")))
    missing_node = F.col("kind_2").isNull() & ~by_hand
    no_evd = ~by_hand & (evd != "yes")
    optional = (F.col("role") == "junc") & (F.col("kind_2") == 1)
    detached = optional & no_evd
    evd_reason = F.when(missing_node, "node_missing").when(detached, None).when(by_hand, None).when(evd == "", "has_evd_missing").when(evd != "yes", "has_evd_not_yes")
    anchor_reason = F.when(detached | by_hand, None).when(anchor == "", "is_anchor_missing").when(~anchor.isin("yes", "fail4_fallback"), "is_anchor_not_eligible")
    checked = rows.select("segment_id", "pos", detached.alias("detached"), by_hand.alias("by_hand"), (anchor == "fail4_fallback").alias("fallback"),
                          evd_reason.alias("e"), anchor_reason.alias("a"))

    def first(reason: str):
        return F.min(F.when(F.col(reason).isNotNull(), F.struct("pos", F.col(reason).alias("r"))))["r"]

    grouped = checked.groupBy("segment_id").agg(first("e").alias("e"), first("a").alias("a"), F.count_if("detached").alias("detached_nodes"),
                                                F.bool_or("by_hand").alias("has_override"), F.bool_or(F.col("fallback") & ~F.col("detached")).alias("has_fallback"))
    stage = F.when(F.col("e").isNotNull(), "before_evd").when(F.col("a").isNotNull(), "after_evd")
    return grouped.select("segment_id", F.when(stage.isNull(), "final").when(stage == "after_evd", "candidate").otherwise("rejected").alias("state"),
                          stage.alias("reject_stage"), F.coalesce("e", "a").alias("reject_reason"), "detached_nodes", "has_override", "has_fallback")


def corridor_candidates(segments: DataFrame, carriers: DataFrame, limit: float, spacing: float, min_ratio: float = 0.2, min_length: float = 1.0) -> DataFrame:
    """Carrier roads along each segment: at least a share or a length of their samples is close to it.

    Advance-right carriers take part only when ``linked``. ``segments`` holds ``segment_id, pts``;
    ``carriers`` holds ``road_id, pts, formway, linked``.
    """
    usable = carriers.where((F.col("formway").bitwiseAND(128) == 0) | F.col("linked"))
    # a generator computes the samples once
    lines = usable.select("road_id", F.inline(F.array(F.struct(G.length(F.col("pts")).alias("length_m"), G.sample(F.col("pts"), spacing).alias("s")))))
    lines = lines.select("road_id", "length_m", F.size("s").alias("samples"), F.posexplode("s").alias("i", "p"))
    probe = lines.select("road_id", "i", "length_m", "samples", F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    # segments of small extent meet the samples in their cell, side by side on arrays
    one, rest = homes(segments, "segment_id")
    placed = probe.where(~F.isnan("x") & ~F.isnan("y")).drop("i")
    around, own = salted_cells(around_homes(placed, "x", "x", "y", "y", limit), one, "segment_id")
    kind, road = (df.schema[c].dataType.simpleString() for df, c in ((segments, "segment_id"), (carriers, "road_id")))
    found = own.groupBy("cx", "cy", "salt").cogroup(around.groupBy("cx", "cy", "salt")).applyInArrow(
        lambda cell, near: corridor_shares(cell, near, limit, min_ratio, min_length), f"segment_id {kind}, road_id {road}, ratio double")
    if rest.isEmpty():
        return found
    near = points_near_lines(probe.select(F.struct("road_id", "i").alias("p_id"), "x", "y"), rest.select(F.col("segment_id").alias("line_id"), "pts"), limit)
    hits = near.groupBy(F.col("line_id").alias("segment_id"), F.col("p_id.road_id").alias("road_id")).agg(F.count("*").alias("hits"))
    joined = hits.join(probe.where("i = 0").select("road_id", "length_m", "samples"), "road_id").withColumn("ratio", F.col("hits") / F.col("samples"))
    kept = joined.where((F.col("ratio") >= min_ratio) | (F.col("ratio") * F.col("length_m") >= min_length))
    return found.unionByName(kept.select("segment_id", "road_id", "ratio"))


def corridor_extract(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Carrier roads kept for each unit: the pruned part that holds both anchors, marked when on the shortest way.

    ``edges`` holds ``unit, src, dst, road_id, length_m``; ``ends`` holds ``unit, a, b``.
    """
    anchors = ends.select("unit", F.explode(F.array("a", "b")).alias("node"))
    kept = prune_leaves(edges, anchors)
    comp = unit_components(kept)
    whole = anchors.join(comp, ["unit", "node"]).groupBy("unit", "component").agg(F.count("*").alias("n")).where("n = 2")
    inside = comp.join(whole, ["unit", "component"], "left_semi").select("unit", F.col("node").alias("src"))
    body = cut(kept.join(inside, ["unit", "src"], "left_semi"))
    around = both_ways(body.select("unit", "src", "dst", "road_id", "length_m"))
    best = shortest_distances(around, ends.select("unit", F.col("a").alias("node")))
    path = trace_back(best, around, ends.select("unit", F.col("b").alias("node"))).select("unit", "road_id").distinct()
    return body.select("unit", "road_id").join(path.withColumn("on_path", F.lit(True)), ["unit", "road_id"], "left").select(
        "unit", "road_id", F.coalesce("on_path", F.lit(False)).alias("on_path"))


def corridor_checks(edges: DataFrame, kept: DataFrame, ends: DataFrame, required: DataFrame) -> DataFrame:
    """Reasons against each extracted corridor: loose ends, missing required nodes, no allowed way."""
    body = edges.join(kept.select("unit", "road_id"), ["unit", "road_id"], "left_semi")
    points = body.select("unit", F.explode(F.array("src", "dst")).alias("node"))
    degree = points.groupBy("unit", "node").agg(F.count("*").alias("d"))
    anchors = ends.select("unit", F.explode(F.array("a", "b")).alias("node"))
    loose = degree.where("d = 1").join(anchors, ["unit", "node"], "left_anti").groupBy("unit").agg(F.count("*").alias("loose"))
    missing = required.join(degree.select("unit", "node"), ["unit", "node"], "left_anti").groupBy("unit").agg(F.count("*").alias("missing"))
    way = pairs_reachable(directed_edges(body), ends).select("unit", "reached")
    joined = ends.select("unit").join(loose, "unit", "left").join(missing, "unit", "left").join(way, "unit", "left")
    reasons = F.concat_ws("|", F.when(F.col("loose") > 0, "leaf_end_not_anchor"), F.when(F.col("missing") > 0, "required_node_missing"),
                          F.when(~F.coalesce("reached", F.lit(False)), "direction_not_satisfied"))
    return joined.select("unit", reasons.alias("reasons"), (reasons == "").alias("passed"))


def resolve_direction(directed: DataFrame, ends: DataFrame) -> DataFrame:
    """Source and target of one-way segments from their own graph; null when both or neither way exists."""
    ways = required_directions(directed, ends)
    one = F.when(F.col("directions") == "pair0_to_pair1", F.struct(F.col("a").alias("s"), F.col("b").alias("t"))).when(
        F.col("directions") == "pair1_to_pair0", F.struct(F.col("b").alias("s"), F.col("a").alias("t")))
    return ways.select("unit", one["s"].alias("source"), one["t"].alias("target"))


def retry_failed(first: DataFrame, rerun: DataFrame, key: str, priority_high) -> DataFrame:
    """First result, replaced by a passing rerun with wider limits where it failed and the grade is high."""
    second = rerun.select(key, F.col("passed").alias("_p"))
    joined = first.join(second, key, "left")
    retried = ~F.col("passed") & priority_high
    return joined.select(key, (F.col("passed") | (retried & F.coalesce("_p", F.lit(False)))).alias("passed"),
                         F.when(F.col("passed"), "first").when(retried & F.coalesce("_p", F.lit(False)), "retry").otherwise("failed").alias("round"))


def retry_anchors(candidates: DataFrame, reach: DataFrame) -> DataFrame:
    """Other end anchors tried for failed segments; taken only when exactly one passes, by least distance otherwise reported.

    ``candidates`` holds ``unit, anchor, dist_m``; ``reach`` holds the passing ``unit, anchor``.
    """
    ok = candidates.join(reach.select("unit", "anchor").distinct(), ["unit", "anchor"], "left_semi")
    best = ok.groupBy("unit").agg(F.count("*").alias("passing"), F.min(F.struct("dist_m", "anchor"))["anchor"].alias("anchor"))
    return best.select("unit", "passing", F.when(F.col("passing") == 1, F.col("anchor")).alias("anchor"),
                       F.when(F.col("passing") == 1, "unique").otherwise("ambiguous").alias("state"))


def special_group_gate(members: DataFrame, replaceable: DataFrame) -> DataFrame:
    """Gate of roundabout and complex groups: passed with nothing missing, partial with some, blocked with none.

    ``members`` holds ``group_id, segment_id``; ``replaceable`` holds ``segment_id``.
    """
    ok = replaceable.select("segment_id").distinct().withColumn("_ok", F.lit(True))
    counts = members.distinct().join(ok, "segment_id", "left").groupBy("group_id").agg(F.count("*").alias("segments"), F.count("_ok").alias("replaceable"))
    return counts.withColumn("gate", F.when(F.col("segments") == F.col("replaceable"), "passed").when(F.col("replaceable") > 0, "partial").otherwise("blocked"))


def replacement_plan(standard: DataFrame, groups: DataFrame, reverse_blockers: DataFrame) -> DataFrame:
    """Plan rows of single segments and groups, ready or blocked with a reason."""
    block = reverse_blockers.select("segment_id").distinct().withColumn("_b", F.lit(True))
    single = standard.join(block, "segment_id", "left").select(
        F.concat(F.lit("segment:"), "segment_id").alias("plan_id"), "segment_id",
        F.when(F.col("_b"), "blocked").otherwise("ready").alias("state"), F.when(F.col("_b"), "reverse_pair_blocked").alias("reason"))
    special = groups.select(F.concat(F.lit("group:"), "group_id").alias("plan_id"), F.lit(None).cast("bigint").alias("segment_id"),
                            F.when(F.col("gate") == "passed", "ready").otherwise("blocked").alias("state"),
                            F.when(F.col("gate") != "passed", F.concat(F.lit("special_group_"), "gate")).alias("reason"))
    return single.unionByName(special)


def plan_road_conflicts(plan_roads: DataFrame) -> DataFrame:
    """Owner of roads that several plans use: best priority, then smallest plan.

    ``plan_roads`` holds ``plan_id, road_id, priority``. Owners are minima combined map-side.
    """
    owner = plan_roads.groupBy("road_id").agg(F.min(F.struct("priority", "plan_id"))["plan_id"].alias("owner"), F.count_distinct("plan_id").alias("n"))
    lost = plan_roads.join(owner.where("n > 1"), "road_id").where(F.col("plan_id") != F.col("owner"))
    per = lost.groupBy("plan_id").agg(F.count_distinct("road_id").alias("lost_roads"), F.count_distinct("owner").alias("rivals"))
    return plan_roads.select("plan_id").distinct().join(per, "plan_id", "left").select(
        "plan_id", F.coalesce("lost_roads", F.lit(0)).alias("lost_roads"), F.coalesce("rivals", F.lit(0)).alias("rivals"),
        F.when(F.col("lost_roads").isNull(), "clear").otherwise("conflict_blocked").alias("gate"))


def junction_alignment_gate(mappings: DataFrame, relations: DataFrame, max_gap: float = 20.0) -> DataFrame:
    """Plans whose carrier node lies far from a junction kept in the source network, unless the relation agrees.

    ``mappings`` holds ``plan_id, target_id, base_id, gap_m, has_retained``.
    """
    agreed = relations.where("status = 0").select("target_id", "base_id", F.lit(True).alias("_rel")).distinct()
    joined = mappings.join(agreed, ["target_id", "base_id"], "left")
    far = F.col("gap_m") > max_gap
    state = (F.when(~far, "aligned").when(F.col("_rel"), "released_by_relation").when(F.col("has_retained"), "blocked").otherwise("far_without_boundary"))
    return joined.select("plan_id", "target_id", "base_id", state.alias("state"))


# Who acts on a rejected segment and how.
PROBLEM_OWNERS = {
    "missing_pair_relation": ("relation", "complete_relation"), "invalid_pair_relation_status": ("relation", "review_relation"),
    "missing_junc_relation": ("relation", "complete_relation"), "invalid_junc_relation_status": ("relation", "review_relation"),
}


def problem_registry(rejected: DataFrame) -> DataFrame:
    """Rejected segments with owner and action for each reason."""
    pairs = [F.lit(x) for reason, (owner, action) in PROBLEM_OWNERS.items() for x in (reason, f"{owner}|{action}")]
    text = F.coalesce(F.element_at(F.create_map(*pairs), F.col("reason")), F.lit("manual|review_segment"))
    return rejected.where(F.col("reason").isNotNull()).select("segment_id", "reason", F.split(text, r"\|")[0].alias("owner"), F.split(text, r"\|")[1].alias("action"))


def replace_network(source_roads: DataFrame, replaced: DataFrame, carriers: DataFrame, chosen: DataFrame) -> DataFrame:
    """Source roads without the replaced ones plus the chosen carriers, tagged by origin."""
    retained = source_roads.join(replaced.select("id").distinct(), "id", "left_anti")
    added = carriers.join(chosen.select("id").distinct(), "id", "left_semi")
    return union_tagged(retained, added)


def rebuild_nodes(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Main node after replacement: source junctions join the carrier they map to, alias chains flattened.

    ``nodes`` holds ``id, mainnodeid``; relations give ``target_id → base_id``.
    """
    own = nodes.where(F.col("mainnodeid").isNotNull() & (F.col("mainnodeid") != F.col("id"))).select(F.col("id").alias("alias_id"), F.col("mainnodeid").alias("target_id"))
    mapped = relations.where("status = 0 AND base_id > 0 AND base_id < target_id").select(F.col("target_id").alias("alias_id"), F.col("base_id").alias("target_id"))
    # the relation of a junction outranks its old main node
    aliases = mapped.unionByName(own.join(mapped.select("alias_id"), "alias_id", "left_anti"))
    flat = flatten_aliases(aliases)
    return nodes.select("id").join(flat.select(F.col("alias_id").alias("id"), "root_id"), "id", "left").select("id", F.coalesce("root_id", "id").alias("mainnodeid"))


def segment_relation_index(segments: DataFrame, retained_roads: DataFrame, carrier_roads: DataFrame) -> DataFrame:
    """State of every segment after replacement: replaced, replaced+retained, retained or failed."""
    r = retained_roads.groupBy("segment_id").agg(F.count("*").alias("retained"))
    c = carrier_roads.groupBy("segment_id").agg(F.count("*").alias("carriers"))
    joined = segments.select("segment_id").join(r, "segment_id", "left").join(c, "segment_id", "left").fillna(0, ["retained", "carriers"])
    state = (F.when((F.col("carriers") > 0) & (F.col("retained") > 0), "replaced+retained_swsd").when(F.col("carriers") > 0, "replaced")
             .when(F.col("retained") > 0, "retained_swsd").otherwise("failed"))
    return joined.withColumn("state", state)


def semantic_junction_groups(relations: DataFrame, positions: DataFrame) -> DataFrame:
    """Carrier junctions that serve several source junctions, with the spread of these."""
    good = relations.where("status = 0 AND base_id > 0").select("target_id", "base_id").distinct()
    placed = good.join(positions.select(F.col("id").alias("target_id"), "x", "y"), "target_id")
    return placed.groupBy("base_id").agg(F.count("*").alias("targets"), F.min("target_id").alias("first_target"),
                                         (F.max("x") - F.min("x")).alias("spread_x"), (F.max("y") - F.min("y")).alias("spread_y")).where("targets > 1")


def topology_audit(roads: DataFrame, nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Audit rows of the final network: ends without node, segments in several parts.

    ``roads`` holds ``road_id, src, dst, segment_id``.
    """
    known = nodes.select("node")
    ends = roads.select("road_id", F.explode(F.array("src", "dst")).alias("node"))
    integrity = ends.join(known, "node", "left_anti").select(F.lit("final_road_node_integrity").alias("layer"), F.lit("road_end_without_node").alias("reason"), F.col("road_id").alias("object_id"))
    comp = unit_components(roads.select(F.col("segment_id").alias("unit"), "src", "dst"))
    parts = comp.groupBy("unit").agg(F.min("component").alias("_a"), F.max("component").alias("_b")).where("_a < _b")
    internal = parts.join(segments.select(F.col("segment_id").alias("unit")), "unit", "left_semi").select(
        F.lit("segment_internal_connectivity").alias("layer"), F.lit("segment_in_several_parts").alias("reason"), F.col("unit").alias("object_id"))
    return integrity.unionAll(internal)


# Category of each audit layer that counts as a final topology failure.
TOPOLOGY_CATEGORY = {
    "final_road_node_integrity": "independent_attachment", "segment_internal_connectivity": "segment_transition",
    "segment_road_connectivity": "segment_transition", "retained_swsd_endpoint_closure": "segment_transition",
    "segment_junction_connectivity": "segment_transition", "patch_road_attachment": "independent_attachment",
    "advance_right_endpoint_connectivity": "independent_attachment",
}


def topology_metric(audit: DataFrame) -> DataFrame:
    """Failing rows and distinct failing objects per category."""
    pairs = [F.lit(x) for kv in TOPOLOGY_CATEGORY.items() for x in kv]
    category = F.element_at(F.create_map(*pairs), F.col("layer"))
    failed = audit.where(category.isNotNull()).withColumn("category", category)
    return failed.groupBy("category").agg(F.count("*").alias("fail_rows"), F.count_distinct("layer", "object_id", "reason").alias("fail_objects"))


def rollback_rounds(plans: DataFrame, links: DataFrame) -> DataFrame:
    """Plans still applied after repeated rollback: a plan falls when one it depends on is not applied.

    ``plans`` holds ``plan_id, fails``; ``links`` holds ``plan_id, needs``. Ends when no plan falls any more.
    """
    state = cut(plans.select("plan_id", F.when(F.col("fails"), 0).alias("round_no")))
    level = 0
    while True:
        level += 1
        fallen = state.where(F.col("round_no") == level - 1).select(F.col("plan_id").alias("needs"))
        hit = cut(links.join(fallen, "needs", "left_semi").select("plan_id").distinct().join(state.where(F.col("round_no").isNull()), "plan_id", "left_semi"))
        if hit.isEmpty():
            return state.select("plan_id", F.when(F.col("round_no").isNull(), "applied").otherwise("rolled_back").alias("state"), "round_no")
        state = cut(state.join(hit.withColumn("_h", F.lit(level)), "plan_id", "left").select("plan_id", F.coalesce("round_no", "_h").alias("round_no")))


def coverage_fallback(segments: DataFrame, limit: float = 15.0, min_ratio: float = 0.9, spacing: float = 10.0) -> DataFrame:
    """Source roads kept because the chosen carrier covers them poorly; ``segments`` holds ``id, pts, carrier``."""
    ratio = G.coverage_ratio(F.col("pts"), F.col("carrier"), limit, spacing)
    return segments.select("id", F.round(ratio, 6).alias("ratio")).withColumn("retain_source", F.col("ratio") < min_ratio)


def uncovered_metrics(segments: DataFrame, limit: float = 15.0, spacing: float = 10.0) -> DataFrame:
    """Length and share of each segment that its carrier does not cover."""
    share = 1 - G.coverage_ratio(F.col("pts"), F.col("carrier"), limit, spacing)
    measured = segments.select("id", G.length(F.col("pts")).alias("len"), share.alias("share"))
    return measured.select("id", F.round(F.col("len") * F.col("share"), 4).alias("uncovered_m"), F.round("share", 6).alias("uncovered_ratio"))


def advance_right_contract(roads: DataFrame, segment_states: DataFrame) -> DataFrame:
    """Carrier choice of advance-right roads from the states of the segments at both ends."""
    s = segment_states.select(F.col("segment_id").alias("from_segment"), F.col("state").alias("_f"))
    t = segment_states.select(F.col("segment_id").alias("to_segment"), F.col("state").alias("_t"))
    joined = roads.join(s, "from_segment", "left").join(t, "to_segment", "left")
    replaced_from, replaced_to = F.col("_f").startswith("replaced"), F.col("_t").startswith("replaced")
    choice = (F.when(F.col("_f").isNull() | F.col("_t").isNull(), "audit_missing_neighbour").when(replaced_from & replaced_to, "use_carrier")
              .when(replaced_from | replaced_to, "attach_source_to_carrier").otherwise("retain_source"))
    return joined.select("road_id", choice.alias("choice"))


def unreplaced_attribution(roads: DataFrame) -> DataFrame:
    """Class of carrier roads that no segment took, tested in the order 5, 4, 3, 2, 1, 6."""
    cls = (F.when(F.expr("planned AND NOT applied"), "5_replaceable_scope_unreplaced").when(F.expr("has_relation AND NOT replaceable"), "4_relation_scope_not_replaceable")
           .when(F.expr("has_evidence AND NOT has_relation"), "3_evidence_scope_no_relation").when(F.expr("in_scope AND NOT has_evidence"), "2_swsd_scope_no_t06_evidence")
           .when(F.expr("NOT in_scope"), "1_outside_swsd_scope").otherwise("6_manual_audit"))
    return roads.withColumn("attribution_class", cls)


def attachment_status(rows: DataFrame, max_gap: float = 1.0) -> DataFrame:
    """pass, warn or fail for every attachment of a source road to the carrier network."""
    state = (F.when(F.col("source_node").isNull() | F.col("carrier_node").isNull(), "fail:node_id_missing").when(~F.col("carrier_exists"), "fail:node_missing")
             .when(F.col("gap_m") > max_gap, "fail:nodes_not_coincident").when(~F.col("carrier_incident"), "fail:carrier_node_isolated")
             .when(F.col("source_main") != F.col("carrier_main"), F.when(F.col("alternate"), "warn:merged_to_alternate").otherwise("fail:mainnode_not_merged"))
             .otherwise("pass:connected"))
    return rows.select("attachment_id", F.split(state, ":")[0].alias("status"), F.split(state, ":")[1].alias("reason"))


def construction_class(rows: DataFrame) -> DataFrame:
    """How completely a segment was built from carriers."""
    ok, rel = F.col("is_replaceable"), F.col("relation_status")
    cls = (F.when(ok & (rel == "replaced"), "2a_complete").when(ok & (rel == "replaced+retained_swsd") & (F.col("side_status") == "missing"), "2b_main_complete_side_missing")
           .when(ok & (rel == "replaced+retained_swsd"), "2c_not_replaceable").when(F.col("pair_status") != "complete", "pair_incomplete")
           .when(F.col("junc_status") != "complete", "pair_only").otherwise("2c_not_replaceable"))
    return rows.select("segment_id", cls.alias("construction_class"))


def buffer_diagnostics(checks: DataFrame) -> DataFrame:
    """Root cause of failed corridors from graph states of the whole network and of the candidates."""
    cause = (F.when(~F.col("full_connected"), "carrier_network_gap").when(~F.col("candidate_connected"), "buffer_scope_too_narrow")
             .when(~F.col("full_directed"), "carrier_direction_gap").when(~F.col("candidate_directed"), "candidate_direction_gap").otherwise("geometry_check_failed"))
    return checks.where(~F.col("passed")).select("unit", cause.alias("root_cause"))


def pair_anchor_diagnostics(ends: DataFrame, hits: DataFrame) -> DataFrame:
    """Which end of a failed segment lacks a place in the carrier network."""
    known = hits.select("node").distinct()
    a = ends.join(known.select(F.col("node").alias("a"), F.lit(True).alias("_a")), "a", "left")
    both = a.join(known.select(F.col("node").alias("b"), F.lit(True).alias("_b")), "b", "left")
    wrong = F.when(F.col("_a").isNull() & F.col("_b").isNull(), "both").when(F.col("_a").isNull(), "start").when(F.col("_b").isNull(), "end").otherwise("none")
    return both.select("unit", wrong.alias("wrong_end"))


def attach_promotion(requests: DataFrame, owned: DataFrame) -> DataFrame:
    """Roads wanted by lost attachments: promoted with one asker and no owner.

    ``requests`` holds ``road_id, segment_id``; ``owned`` holds ``road_id, segment_id``.
    """
    asked = requests.groupBy("road_id").agg(F.count_distinct("segment_id").alias("askers"), F.min("segment_id").alias("asker"))
    has = owned.groupBy("road_id").agg(F.min("segment_id").alias("lo"), F.max("segment_id").alias("hi"))
    joined = asked.join(has, "road_id", "left")
    foreign = F.coalesce((F.col("lo") != F.col("asker")) | (F.col("hi") != F.col("asker")), F.lit(False))
    state = F.when(F.col("askers") > 1, "several_askers").when(foreign, "owned_by_other").otherwise("promoted")
    return joined.select("road_id", state.alias("state"), F.when(state == "promoted", F.col("asker")).alias("segment_id"))


def lost_attach_roads(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Roads at the nodes of a kept corridor that are not part of it."""
    nodes = edges.join(kept.select("unit", "road_id"), ["unit", "road_id"], "left_semi").select("unit", F.explode(F.array("src", "dst")).alias("node")).distinct()
    around = edges.select("road_id", F.explode(F.array("src", "dst")).alias("node")).join(nodes, "node").select("unit", "road_id").distinct()
    return around.join(kept.select("unit", "road_id"), ["unit", "road_id"], "left_anti")


def bidirectional_reality(source: DataFrame, carrier: DataFrame, ends: DataFrame) -> DataFrame:
    """Segments passable one way in the source but both ways in the carrier network."""
    a = required_directions(source, ends).select("unit", F.col("directions").alias("source_ways"))
    b = required_directions(carrier, ends).select("unit", F.col("directions").alias("carrier_ways"))
    both = F.col("carrier_ways").contains("pair0_to_pair1") & F.col("carrier_ways").contains("pair1_to_pair0")
    one = (F.col("source_ways") != "") & ~F.col("source_ways").contains(",")
    return a.join(b, "unit").select("unit", "source_ways", "carrier_ways", (one & both).alias("flagged"))


def semantic_endpoint_retry(failed: DataFrame, edges: DataFrame, extra: DataFrame) -> DataFrame:
    """Failed one-way segments that pass when advance-right roads may close the gap."""
    widened = directed_edges(edges.unionByName(extra))
    return pairs_reachable(widened, failed).select("unit", "a", "b", F.when(F.col("reached"), "passed_by_advance_right").otherwise("failed").alias("state"))


def group_assignments(members: DataFrame, priority: DataFrame) -> DataFrame:
    """Groups of segments that share carrier roads, led by the segment of best priority."""
    comp = conflict_components(members.select(F.col("segment_id").alias("owner"), F.col("road_id").alias("member")))
    ranked = comp.join(priority.select(F.col("segment_id").alias("owner"), "priority"), "owner")
    lead = ranked.groupBy("component").agg(F.count("*").alias("segments"), F.min(F.struct("priority", "owner"))["owner"].alias("leader"))
    return lead.where("segments > 1")


def supplement_end_nodes(roads: DataFrame, nodes: DataFrame, pool: DataFrame) -> DataFrame:
    """Nodes that roads need but the layer lacks, taken from a pool where it has them."""
    needed = roads.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes.select("node"), "node", "left_anti")
    return needed.join(pool.select("node", "x", "y"), "node", "left").select("node", F.col("x").isNotNull().alias("found"))


def backfill_node_map(maps: DataFrame, peers: DataFrame) -> DataFrame:
    """Missing carrier nodes of a segment filled from peers that agree on one value."""
    agreed = peers.where(F.col("base_id").isNotNull()).groupBy("node_id").agg(F.min("base_id").alias("lo"), F.max("base_id").alias("hi")).where("lo = hi")
    joined = maps.join(agreed.select("node_id", F.col("lo").alias("_peer")), "node_id", "left")
    return joined.select("segment_id", "node_id", F.coalesce("base_id", "_peer").alias("base_id"), (F.col("base_id").isNull() & F.col("_peer").isNotNull()).alias("filled"))


def transition_closure(rolled_back: DataFrame, members: DataFrame, allowed: DataFrame) -> DataFrame:
    """Segments that must follow a rollback: allowed neighbours on junctions touched by exactly one rolled-back segment."""
    touched = members.join(rolled_back.select("segment_id"), "segment_id", "left_semi").groupBy("node_id").agg(F.count_distinct("segment_id").alias("n"))
    once = touched.where("n = 1").select("node_id")
    near = members.join(once, "node_id", "left_semi").select("segment_id").distinct()
    return near.join(rolled_back.select("segment_id"), "segment_id", "left_anti").join(allowed.select("segment_id"), "segment_id", "left_semi")


def release_blocked(plan: DataFrame, relations: DataFrame) -> DataFrame:
    """Blocked plan rows released when every mapped junction agrees with the published relation."""
    agreed = relations.where("status = 0").select("target_id", "base_id", F.lit(True).alias("_r")).distinct()
    per = plan.join(agreed, ["target_id", "base_id"], "left").groupBy("plan_id", "state").agg(F.bool_and(F.coalesce("_r", F.lit(False))).alias("agrees"))
    return per.select("plan_id", F.when((F.col("state") == "blocked") & F.col("agrees"), "released").otherwise(F.col("state")).alias("state"))


def surface_topology_rows(nodes: DataFrame, surfaces: DataFrame, hits: DataFrame) -> DataFrame:
    """Surface evidence of junctions after replacement: how many junctions a surface holds and what blocks it."""
    per = hits.groupBy("surface_id").agg(F.count_distinct("node").alias("junctions"), F.min("node").alias("first_junction"))
    joined = surfaces.select("surface_id").join(per, "surface_id", "left")
    return joined.select("surface_id", F.coalesce("junctions", F.lit(0)).alias("junctions"),
                         F.when(F.col("junctions").isNull(), "surface_without_junction").when(F.col("junctions") > 1, "several_junctions").alias("blocking_reason"))


def special_internal_roads(roads: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Inner roads of special groups whose gate is passed."""
    open_nodes = members.join(groups.where("gate = 'passed'").select("group_id"), "group_id", "left_semi")
    a = open_nodes.select("group_id", F.col("node").alias("src"))
    b = open_nodes.select("group_id", F.col("node").alias("dst"))
    return roads.join(a, "src").join(b, ["group_id", "dst"]).select("group_id", "road_id").distinct()


def advance_right_postprocess(roads: DataFrame, states: DataFrame, nodes: DataFrame) -> DataFrame:
    """Retained advance-right roads tied to the carrier node of the replaced neighbour at either end."""
    mapped = nodes.select("node", "carrier_node")
    a = roads.join(mapped.select(F.col("node").alias("src"), F.col("carrier_node").alias("_s")), "src", "left")
    both = a.join(mapped.select(F.col("node").alias("dst"), F.col("carrier_node").alias("_d")), "dst", "left")
    kept = both.join(states.where("choice = 'attach_source_to_carrier'").select("road_id"), "road_id", "left_semi")
    return kept.select("road_id", F.coalesce("_s", "src").alias("src"), F.coalesce("_d", "dst").alias("dst"), (F.col("_s").isNotNull() | F.col("_d").isNotNull()).alias("attached"))
