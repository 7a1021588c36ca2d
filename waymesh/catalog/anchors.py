"""Anchoring, virtual junctions and relation publication."""
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalar import rounded
from ..operators import graph as GR
from ..operators import joins as J
from ..operators import spatial as SP
from ..operators.arms import incident_ends
from ..operators.assignment import greedy_assignment
from ..operators.cells import assemble_surface
from ..plans import anchor as AN
from ..plans.preprocess import roundabout_nodes
from .graphs import chain_edges, end_pairs
from .joins import arms, canon_roads, relation_last
from .preprocess import surface_hits
from .registry import query
from .views import VIEW_SQL

VIEW_SQL["junction_hits"] = "SELECT DISTINCT canonical_id AS junction_id, surface_id FROM canon JOIN net_nodes n ON n.id = node_id JOIN surfaces s ON n.x BETWEEN x0 AND x1 AND n.y BETWEEN y0 AND y1"
VIEW_SQL["anchor_groups"] = """SELECT canonical_id AS junction_id, any_value(n.kind_2) AS kind_2, CASE WHEN any_value(n.grade_2) <> 3 THEN 'yes' END AS has_evd, count(*) AS members
    FROM canon JOIN net_nodes n ON n.id = canonical_id GROUP BY canonical_id"""
VIEW_SQL["anchor_result"] = """SELECT g.junction_id, g.kind_2, coalesce(c.n, 0) AS surfaces, CASE WHEN has_evd IS NULL THEN NULL WHEN f.junction_id IS NOT NULL THEN 'fail2' WHEN kind_2 IN (64, 128) THEN 'no'
    WHEN coalesce(c.n, 0) = 0 THEN 'no' WHEN c.n = 1 OR members = 1 THEN 'yes' ELSE 'fail1' END AS is_anchor FROM anchor_groups g LEFT JOIN (SELECT junction_id, count(*) AS n FROM junction_hits GROUP BY 1) c USING (junction_id)
    LEFT JOIN (SELECT DISTINCT junction_id FROM junction_hits JOIN anchor_groups USING (junction_id) WHERE has_evd = 'yes' AND kind_2 <> 1 AND surface_id IN (SELECT surface_id FROM junction_hits
    JOIN anchor_groups USING (junction_id) WHERE has_evd = 'yes' AND kind_2 <> 1 GROUP BY surface_id HAVING count(*) > 1)) f USING (junction_id)"""


def junction_hits(v):
    aliases = J.canonical_nodes(v.net_nodes)
    hits = surface_hits(v).select(F.col("p_id").alias("node_id"), F.col("ring_id").alias("surface_id"))
    return hits.join(aliases, "node_id").select(F.col("canonical_id").alias("junction_id"), "surface_id").distinct()


def anchor_groups(v):
    sizes = J.canonical_nodes(v.net_nodes).groupBy(F.col("canonical_id").alias("junction_id")).agg(F.count("*").alias("members"))
    return v.net_nodes.select(F.col("id").alias("junction_id"), "kind_2", F.when(F.col("grade_2") != 3, "yes").alias("has_evd")).join(sizes, "junction_id")


def anchor_result(v):
    return AN.anchor_states(anchor_groups(v), junction_hits(v))


@query("anchor_states", "SELECT * FROM anchor_result")
def _(v):
    return anchor_result(v)


VIEW_SQL["carrier_hits"] = "SELECT DISTINCT surface_id, l.id AS carrier_id FROM surfaces s JOIN link_roads l ON l.x0 BETWEEN s.x0 AND s.x1 AND l.y0 BETWEEN s.y0 AND s.y1"


def carrier_hits(v):
    points = v.link_roads.select(F.col("id").alias("p_id"), F.col("pts")[0]["x"].alias("x"), F.col("pts")[0]["y"].alias("y"))
    return SP.points_in_rings(points, v.surfaces.select(F.col("surface_id").alias("ring_id"), "ring"), 40.0).select(
        F.col("ring_id").alias("surface_id"), F.col("p_id").alias("carrier_id"))


@query("surface_has_carrier_node", "SELECT junction_id, surface_id FROM junction_hits WHERE surface_id IN (SELECT surface_id FROM carrier_hits)")
def _(v):
    return AN.surfaces_with_carrier(junction_hits(v), carrier_hits(v)).select("junction_id", "surface_id")


@query("relation_supplement", """WITH b AS (SELECT target_id, base_id, 0 AS p FROM relations WHERE status = 0 AND base_id > 0 AND target_id % 2 = 0 UNION ALL SELECT target_id, base_id, 1 FROM relation_last WHERE status = 0 AND base_id > 0
    AND base_id IN (SELECT id FROM link_roads)) SELECT target_id, min(p * 1000000000::BIGINT + base_id) % 1000000000 AS base_id, CASE WHEN min(p) = 0 THEN 'published' ELSE 'supplement' END AS source FROM b GROUP BY target_id""")
def _(v):
    return AN.supplement_relations(v.relations.where("target_id % 2 = 0"), relation_last(v), v.link_roads.select(F.col("id").alias("base_id")))


@query("virtual_candidate_select", """SELECT junction_id, r.kind_2, CASE WHEN r.kind_2 IN (4, 2048) THEN 'virtual_junction' ELSE 'divmerge' END AS method FROM anchor_result r JOIN anchor_groups g USING (junction_id)
    WHERE has_evd = 'yes' AND is_anchor = 'no' AND r.kind_2 IN (4, 2048, 8, 16, 128)""")
def _(v):
    states = anchor_result(v).join(anchor_groups(v).select("junction_id", "has_evd"), "junction_id")
    return AN.virtual_candidates(states)


@query("junction_template", "SELECT id, CASE kind_2 WHEN 4 THEN 'center_junction' WHEN 2048 THEN 'single_sided_t_mouth' END AS template FROM net_nodes")
def _(v):
    return v.net_nodes.select("id", AN.junction_template(F.col("kind_2")).alias("template"))


@query("reachable_support", """WITH r(unit, node, d, seen) AS (SELECT id, id, 0::BIGINT, [id] FROM net_nodes WHERE id % 4 = 1 UNION ALL SELECT r.unit, e.dst, r.d + e.length_m, list_append(seen, e.dst) FROM r
    JOIN chain_both e ON e.src = r.node WHERE (r.node = r.unit OR r.node % 4 <> 1) AND NOT list_contains(seen, e.dst) AND r.d + e.length_m <= 50) SELECT unit, node, CAST(min(d) AS DOUBLE) AS dist_m FROM r WHERE unit <> node GROUP BY ALL""")
def _(v):
    junctions = v.net_nodes.where(F.col("id") % 4 == 1).select(F.col("id").alias("unit"), F.col("id").alias("node"))
    edges = GR.both_ways(chain_edges(v).select("src", "dst", "road_id", "length_m"))
    reached = GR.distances_through(edges, junctions, junctions.select("node"), 50.0)
    return reached.where("unit != node").select("unit", "node", "dist_m")


@query("association_class", """WITH e AS (SELECT p_id AS junction_id, CASE kind_2 WHEN 4 THEN 'center_junction' ELSE 'single_sided_t_mouth' END AS template, dist, line_id % 5 = 0 AS compact, line_id % 4 + 1 AS degree, line_id % 3 = 0 AS req
    FROM node_link_dist JOIN net_nodes ON id = p_id WHERE dist <= 25 AND kind_2 IN (4, 2048)), s AS (SELECT junction_id, template, count_if(req) AS required, count_if(req AND dist <= 8) AS near, count_if(req AND dist <= 15) AS paired,
    count_if(req AND compact AND degree >= 3) AS compact, count_if(NOT req) AS support FROM e GROUP BY ALL), c AS (SELECT *, required > 0 AND ((template = 'center_junction' AND (near > 0 OR paired >= 2 OR compact > 0)) OR
    (template = 'single_sided_t_mouth' AND (required >= 2 OR near > 0 OR compact > 0))) AS core FROM s) SELECT junction_id, template, CASE WHEN core THEN 'A' ELSE 'B' END AS association_class,
    CASE WHEN core THEN 'required_core_retained' WHEN required > 0 THEN 'required_core_dropped' ELSE 'association_support_only' END AS reason FROM c""")
def _(v):
    points = v.net_nodes.where(F.col("kind_2").isin(4, 2048)).select(F.col("id").alias("p_id"), "x", "y", "kind_2")
    near = SP.points_near_lines(points, v.link_roads.select(F.col("id").alias("line_id"), "pts"), 25.0).join(points.select("p_id", "kind_2"), "p_id")
    line = F.col("line_id")
    evidence = near.select(F.col("p_id").alias("junction_id"), AN.junction_template(F.col("kind_2")).alias("template"), line.alias("group_id"), F.col("dist").alias("dist_m"),
                           (line % 5 == 0).alias("compact"), (line % 4 + 1).alias("degree"), (line % 3 == 0).alias("is_required"))
    return AN.association_class(evidence)


@query("direction_cluster_gate")
def _(v):
    ends = incident_ends(canon_roads(v)).where(F.col("angle").isNotNull()).select("junction_id", (F.col("id") % 2).cast("int").alias("side"), "angle")
    return AN.direction_gate(AN.axis_clusters(ends, 25.0), 25.0)


@query("raw_topology_guard", """WITH pairs AS (SELECT (id - 1) // 8 AS unit, id AS a, id + 5 AS b FROM net_nodes WHERE id % 8 = 1 AND id + 5 <= (SELECT count(*) FROM customer)),
    k AS (SELECT * FROM chain_edges WHERE road_id % 5 <> 0), d AS (SELECT unit, src, dst FROM k WHERE direction <> 3 UNION ALL SELECT unit, dst, src FROM k WHERE direction <> 2), u AS (SELECT unit, src, dst FROM k UNION SELECT unit, dst, src FROM k),
    c(unit, node, other) AS (SELECT unit, src, src FROM u UNION SELECT c.unit, c.node, u.dst FROM c JOIN u ON u.unit = c.unit AND u.src = c.other), m AS (SELECT unit, node, min(other) AS comp FROM c GROUP BY ALL),
    f(unit, node) AS (SELECT unit, a FROM pairs UNION SELECT f.unit, d.dst FROM f JOIN d ON d.unit = f.unit AND d.src = f.node), g(unit, node) AS (SELECT unit, b FROM pairs UNION SELECT g.unit, d.dst FROM g JOIN d ON d.unit = g.unit AND d.src = g.node),
    q AS (SELECT p.unit, concat_ws('|', CASE WHEN (SELECT count(DISTINCT comp) FROM m WHERE m.unit = p.unit) > 1 THEN 'multi_component_support' END, CASE WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.unit = p.unit AND f.node = p.b)
    AND NOT EXISTS (SELECT 1 FROM g WHERE g.unit = p.unit AND g.node = p.a) THEN 'directional_mismatch' END) AS reasons FROM pairs p) SELECT unit, reasons, reasons = '' AS passed FROM q""")
def _(v):
    support = chain_edges(v).where(F.col("road_id") % 5 != 0)
    return AN.topology_guard(support, end_pairs(v), GR.directed_edges(support))


@query("foreign_objects", """SELECT r.target_id AS junction_id, r.base_id AS carrier_id FROM relations r JOIN (SELECT base_id, min(target_id) AS lo, max(target_id) AS hi FROM relations WHERE status = 0 GROUP BY 1) o USING (base_id)
    WHERE r.status = 1 AND (lo <> r.target_id OR hi <> r.target_id)""")
def _(v):
    rows = v.relations.select(F.col("target_id").alias("junction_id"), F.col("base_id").alias("carrier_id"), "status")
    return AN.foreign_objects(rows.where("status = 1").drop("status"), rows.where("status = 0").drop("status"))


@query("divmerge_candidate_score", """SELECT o_orderkey, round(0.30 * ((o_orderkey % 21 - 10) / 10.0) + 0.25 * ((CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 ELSE 0.0 END + CASE o_orderkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.65 WHEN 2 THEN 0.15
    ELSE -0.15 END) / 2) + 0.25 * CASE WHEN o_orderkey % 2 = 0 THEN 1.0 ELSE 0.35 END - 0.10 * (o_orderkey % 5) / 5.0 - 0.10 * (o_orderkey % 7) / 7.0, 6) AS score FROM orders""")
def _(v):
    o = F.col("o_orderkey")
    support = F.element_at(F.array(*[F.lit(s) for s in ("primary_support", "secondary_support", "no_support")]), (o % 3 + 1).cast("int"))
    consistency = F.element_at(F.array(*[F.lit(s) for s in ("A", "B", "C", "")]), (o % 4 + 1).cast("int"))
    score = AN.divmerge_score(support, consistency, (o % 21 - 10) / 10.0, o % 2 == 0, (o % 5) / 5.0, (o % 7) / 7.0)
    return v.orders.select("o_orderkey", rounded(score).alias("score"))


def unit_pairs(v):
    """Event units of a case with the carriers they may take and a score."""
    u, r = F.col("l_partkey"), F.col("l_suppkey")
    return v.lineitem.select(F.col("l_orderkey").alias("unit"), u.alias("left"), (r % 3).alias("right"), ((u * 13 + r * 7) % 97).cast("double").alias("score")).groupBy(
        "unit", "left", "right").agg(F.max("score").alias("score"))


@query("divmerge_arbitrate")
def _(v):
    return greedy_assignment(unit_pairs(v)).select("unit", "left", "right", "score")


@query("claim_conflicts")
def _(v):
    claims = v.relations.where("status = 0").select(F.col("target_id").alias("case_id"), F.col("base_id").alias("carrier_id"), ((F.col("target_id") * 31 + F.col("base_id")) % 89).alias("score"))
    return AN.claim_conflicts(claims)


@query("event_units", """WITH a AS (SELECT arms.* FROM arms JOIN net_nodes ON id = junction_id WHERE kind_2 = 128), p AS (SELECT junction_id, sector, coalesce(lead(sector) OVER w, min(sector) OVER (PARTITION BY junction_id)) AS next_sector,
    count(*) OVER (PARTITION BY junction_id) AS branches, CAST(row_number() OVER w AS INTEGER) AS unit_no FROM a WINDOW w AS (PARTITION BY junction_id ORDER BY sector)) SELECT * FROM p WHERE branches >= 3 OR (branches = 2 AND unit_no = 1)""")
def _(v):
    complex_nodes = v.net_nodes.where("kind_2 = 128").select(F.col("id").alias("junction_id"))
    return AN.event_units(arms(v).join(complex_nodes, "junction_id", "left_semi"))


@query("accept_reject", """SELECT doc_id AS case_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'rejected' ELSE 'accepted' END AS state, CASE WHEN doc_id % 7 = 0 THEN 'step7_blocked_by_association' WHEN doc_id % 5 = 0 THEN
    'step7_rejected_after_step6_failure' WHEN doc_id % 11 = 0 THEN 'step7_accepted_with_upstream_step3_visual_risk' WHEN doc_id % 4 > 1 THEN 'step7_accepted_with_visual_risk' WHEN doc_id % 6 = 1 THEN 'step7_accepted_after_support_only_convergence'
    ELSE 'step7_accepted' END AS reason, CASE WHEN doc_id % 7 = 0 THEN 'V5' WHEN doc_id % 5 = 0 THEN CASE doc_id % 3 WHEN 0 THEN 'V3' WHEN 1 THEN 'V4' ELSE 'V5' END WHEN doc_id % 11 = 0 OR doc_id % 4 > 1 THEN 'V2' ELSE 'V1' END AS visual_class FROM documents""")
def _(v):
    d = F.col("doc_id")
    cause = F.element_at(F.array(F.lit("stage3_rc_gap"), F.lit("foreign_road"), F.lit("other")), (d % 3 + 1).cast("int"))
    cases = v.documents.select(d.alias("case_id"), F.when(d % 7 == 0, "not_established").otherwise("established").alias("association_state"), (d % 5 != 0).alias("geometry_ok"),
                               (d % 11 == 0).alias("upstream_review"), F.greatest(F.lit(0), d % 4 - 1).alias("signals"), (d % 6 == 1).alias("support_only"), cause.alias("cause"))
    return AN.accept_reject(cases)


@query("grid_surface_assembly")
def _(v):
    cells = v.surfaces.select(F.col("surface_id").alias("unit"), "x0", "y0", "x1", "y1", F.explode(
        G.cells_of_ring(F.col("ring"), 5.0)).alias("c")).select("unit", "c.cx", "c.cy", "x0", "y0", "x1", "y1")
    center_x, center_y = F.floor((F.col("x0") + F.col("x1")) / 10), F.floor((F.col("y0") + F.col("y1")) / 10)
    seeds = v.surfaces.select(F.col("surface_id").alias("unit"), F.floor(F.col("x0") / 5 + 1).alias("cx"), F.floor(F.col("y0") / 5 + 1).alias("cy"))
    forbidden = cells.where((F.col("cx") == center_x) & (F.col("cy") < center_y)).select("unit", "cx", "cy")
    return assemble_surface(cells, seeds, forbidden).groupBy("unit").agg(F.count("*").alias("cells"), F.count_if(F.col("part") == "hole").alias("holes"))


def evidence_rows(v):
    o = F.col("o_orderkey")

    def pick(values, by):
        return F.element_at(F.array(*[F.lit(x) for x in values]), (by % len(values) + 1).cast("int"))

    return v.orders.select(
        (o % v.n_part + 1).alias("target_id"), o.alias("evidence_id"), pick(("T11_MANUAL", "T07", "T03", "T04", "T02_INPUT"), o).alias("source"),
        pick(("existing_rcsdintersection_matched", "multiple_intersections_for_group", "rcsd_present_not_junction", "no_related_rcsd"), F.floor(o / 5)).alias("relation_state"),
        F.when(o % 2 == 0, "0").otherwise("1").alias("status_suggested"), (F.floor(o / 3) % 3).alias("base_count"), (F.floor(o / 7) % 3).alias("required_count"),
        (o % 4).alias("selected_count"), (F.floor(o / 11) % 2).alias("road_count"), F.when(o % 6 < 3, "complex_divmerge").otherwise("center_junction").alias("junction_type"),
        pick(("1v1_rcsd_junction", "1vN_rcsd_junction", "1v1_rcsd_road", "other"), F.floor(o / 13)).alias("manual_type"), (F.col("o_custkey") + 1).alias("base_id"))


VIEW_SQL["evidence"] = """SELECT o_orderkey % (SELECT count(*) FROM part) + 1 AS target_id, o_orderkey AS evidence_id, ['T11_MANUAL', 'T07', 'T03', 'T04', 'T02_INPUT'][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS source,
    ['existing_rcsdintersection_matched', 'multiple_intersections_for_group', 'rcsd_present_not_junction', 'no_related_rcsd'][CAST(o_orderkey // 5 % 4 + 1 AS INTEGER)] AS relation_state,
    CASE WHEN o_orderkey % 2 = 0 THEN '0' ELSE '1' END AS status_suggested, o_orderkey // 3 % 3 AS base_count, o_orderkey // 7 % 3 AS required_count, o_orderkey % 4 AS selected_count, o_orderkey // 11 % 2 AS road_count,
    CASE WHEN o_orderkey % 6 < 3 THEN 'complex_divmerge' ELSE 'center_junction' END AS junction_type, ['1v1_rcsd_junction', '1vN_rcsd_junction', '1v1_rcsd_road', 'other'][CAST(o_orderkey // 13 % 4 + 1 AS INTEGER)] AS manual_type,
    o_custkey + 1 AS base_id FROM orders"""
VIEW_SQL["scenes"] = """SELECT *, CASE WHEN source = 'T11_MANUAL' THEN CASE WHEN base_count = 0 THEN 'failure' WHEN manual_type = '1v1_rcsd_junction' THEN 'direct' WHEN manual_type = '1vN_rcsd_junction' THEN 'group_existing'
    WHEN manual_type = '1v1_rcsd_road' THEN 'road_split' ELSE 'failure' END WHEN source = 'T02_INPUT' THEN CASE WHEN relation_state = 'existing_rcsdintersection_matched' AND base_count > 0 THEN 'direct' ELSE 'failure' END
    WHEN source = 'T07' AND relation_state = 'multiple_intersections_for_group' THEN CASE WHEN base_count > 1 THEN 'group_existing' ELSE 'failure' END WHEN source = 'T07' AND relation_state = 'existing_rcsdintersection_matched' AND
    status_suggested = '0' THEN 'direct' WHEN base_count > 0 AND status_suggested = '0' THEN 'direct' WHEN required_count = 1 THEN 'direct' WHEN required_count > 1 THEN 'group_existing' WHEN source = 'T04' AND
    junction_type = 'complex_divmerge' AND selected_count > 1 THEN 'group_existing' WHEN relation_state = 'rcsd_present_not_junction' AND road_count > 0 THEN 'road_split' WHEN relation_state = 'no_related_rcsd' THEN 'no_rcsd' ELSE 'failure' END AS scene FROM evidence"""


@query("scene_decision", "SELECT evidence_id, target_id, source, scene FROM scenes")
def _(v):
    return AN.scene_decision(evidence_rows(v)).select("evidence_id", "target_id", "source", "scene")


VIEW_SQL["published"] = """SELECT id AS target_id, CASE WHEN ok THEN base_id ELSE 0 END AS base_id, CASE WHEN ok THEN 0 ELSE 1 END AS status, scene, source FROM (SELECT l.id, d.base_id, coalesce(d.scene, 'missing_evidence') AS scene, d.source,
    coalesce(d.scene IN ('direct', 'group_existing', 'road_split') AND d.base_id > 0, false) AS ok FROM link_roads l LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY
    CASE WHEN source = 'T11_MANUAL' AND scene IN ('direct', 'group_existing', 'road_split') THEN 0 ELSE 1 END, list_position(['direct', 'group_existing', 'road_split', 'no_rcsd', 'failure'], scene),
    list_position(['T11_MANUAL', 'T07', 'T03', 'T04', 'T02_INPUT'], source), base_id) AS rn FROM scenes) d ON d.target_id = l.id AND rn = 1)"""


@query("relation_publish", "SELECT * FROM published")
def _(v):
    return AN.publish_relations(AN.scene_decision(evidence_rows(v)), v.link_roads.select(F.col("id").alias("target_id")))


@query("node_grouping", """SELECT target_id, node_id, CASE WHEN count(*) OVER (PARTITION BY target_id) > 1 THEN first_value(node_id) OVER (PARTITION BY target_id ORDER BY d, node_id) END AS mainnodeid FROM (SELECT DISTINCT l_suppkey AS target_id,
    l_partkey AS node_id, (l_partkey * 7 + l_suppkey * 3) % 50 AS d FROM lineitem)""")
def _(v):
    members = v.lineitem.select(F.col("l_suppkey").alias("target_id"), F.col("l_partkey").alias("node_id"), ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 3) % 50).alias("dist_m")).distinct()
    return AN.group_nodes(members)


@query("road_split_generate")
def _(v):
    roads = v.net_roads.select(F.col("id").alias("road_id"), "snodeid", "enodeid", "pts")
    points = v.net_roads.select(F.col("id").alias("road_id"), ((F.col("pts")[1]["x"] + F.col("pts")[2]["x"]) / 2).alias("x"), ((F.col("pts")[1]["y"] + F.col("pts")[2]["y"]) / 2).alias("y"))
    pieces = AN.split_roads(roads, points, 1_000_000_000)
    return pieces.select("source_road_id", "road_id", "snodeid", "enodeid")


@query("roundabout_aggregate")
def _(v):
    hits = surface_hits(v).select(F.col("p_id").alias("node"), F.col("ring_id").alias("surface_id"))
    return AN.aggregate_roundabouts(roundabout_nodes(chain_edges(v)), hits, carrier_hits(v))


@query("evidence_backfill", """SELECT a.id, coalesce(CASE WHEN a.id % 3 <> 0 THEN base_a END, b.base_id) AS base_id, coalesce(CASE WHEN a.id % 4 <> 0 THEN 'self' END, b.note) AS note,
    (a.id % 3 = 0 AND b.base_id IS NOT NULL) OR (a.id % 4 = 0 AND b.note IS NOT NULL) AS backfilled FROM (SELECT id, id * 2 AS base_a FROM link_roads) a LEFT JOIN (SELECT id, id * 5 AS base_id, 'case' AS note FROM link_roads WHERE id % 5 < 3) b ON b.id = a.id""")
def _(v):
    i = F.col("id")
    rows = v.link_roads.select("id", F.when(i % 3 != 0, i * 2).alias("base_id"), F.when(i % 4 != 0, "self").alias("note"))
    cases = v.link_roads.where(i % 5 < 3).select("id", (i * 5).alias("base_id"), F.lit("case").alias("note"))
    return AN.backfill_evidence(rows, cases, "id", ["base_id", "note"])
