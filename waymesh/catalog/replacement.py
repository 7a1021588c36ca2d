"""Replacement of segments by carrier roads, and its audits."""
from pyspark.sql import functions as F

from ..operators import graph as GR
from ..operators import joins as J
from ..plans import replace as RP
from ..plans.quality import road_owners
from .geometry import chord
from .graphs import chain_edges, components_sql, end_pairs
from .joins import canon_roads, relation_last
from .preprocess import node_kinds, surface_hits
from .registry import query
from .views import VIEW_SQL

VIEW_SQL["node_states"] = """SELECT id AS node_id, CASE WHEN id % 17 = 0 THEN NULL WHEN id % 13 = 0 THEN 'no' ELSE 'yes' END AS has_evd, CASE WHEN id % 19 = 0 THEN NULL WHEN id % 5 = 0 THEN 'fail4_fallback'
    WHEN id % 7 = 0 THEN 'no' ELSE 'yes' END AS is_anchor, CAST(id % 3 AS INTEGER) AS kind_2 FROM link_roads"""
VIEW_SQL["plan_roads"] = "SELECT DISTINCT l_orderkey + 1 AS plan_id, l_partkey + 1 AS road_id, (l_orderkey * 7) % 11 AS priority FROM lineitem"
VIEW_SQL["lookup"] = """SELECT segment_id, arg_min(reason, pos) FILTER (WHERE reason IS NOT NULL) AS reason FROM (SELECT s.*, CASE WHEN r.target_id IS NULL THEN 'missing_' || role || '_relation'
    WHEN r.status <> 0 THEN 'invalid_' || role || '_relation_status' WHEN r.base_id <= 0 THEN 'invalid_' || role || '_base_id' END AS reason FROM seg_nodes s LEFT JOIN relation_last r ON r.target_id = s.node_id) GROUP BY segment_id"""
VIEW_SQL["gates"] = """SELECT group_id, count(*) AS segments, count(CASE WHEN reason IS NULL THEN 1 END) AS replaceable, CASE WHEN count(*) = count(CASE WHEN reason IS NULL THEN 1 END) THEN 'passed'
    WHEN count(CASE WHEN reason IS NULL THEN 1 END) > 0 THEN 'partial' ELSE 'blocked' END AS gate FROM (SELECT DISTINCT s.node_id AS group_id, segment_id, reason FROM seg_nodes s JOIN lookup USING (segment_id) WHERE s.node_id % 3 = 0) GROUP BY 1"""


def node_states(v):
    i = F.col("id")
    return v.link_roads.select(i.alias("node_id"), F.when(i % 17 == 0, None).when(i % 13 == 0, "no").otherwise("yes").alias("has_evd"),
                               F.when(i % 19 == 0, None).when(i % 5 == 0, "fail4_fallback").when(i % 7 == 0, "no").otherwise("yes").alias("is_anchor"), (i % 3).cast("int").alias("kind_2"))


def plan_roads(v):
    return v.lineitem.select((F.col("l_orderkey") + 1).alias("plan_id"), (F.col("l_partkey") + 1).alias("road_id"), (F.col("l_orderkey") * 7 % 11).alias("priority")).distinct()


def lookup(v):
    return J.relation_lookup(v.seg_nodes, relation_last(v))


def gates(v):
    members = v.seg_nodes.where("node_id % 3 = 0").select(F.col("node_id").alias("group_id"), "segment_id")
    return RP.special_group_gate(members, lookup(v).where("passed"))


def with_carrier(v):
    return v.spread(v.net_roads).select("id", "pts", chord(F.col("pts")).alias("carrier"))


@query("fusion_units", """WITH c AS (SELECT s.segment_id, pos, m.id IS NOT NULL AS h, n.node_id IS NULL AND m.id IS NULL AS lost, coalesce(role = 'junc' AND n.kind_2 = 1 AND m.id IS NULL AND coalesce(has_evd, '') <> 'yes', false) AS det,
    coalesce(has_evd, '') AS e, coalesce(is_anchor, '') AS a FROM seg_nodes s LEFT JOIN node_states n USING (node_id) LEFT JOIN (SELECT s_suppkey * 5 + 2 AS id FROM supplier) m ON m.id = s.node_id),
    r AS (SELECT *, CASE WHEN lost THEN 'node_missing' WHEN det OR h THEN NULL WHEN e = '' THEN 'has_evd_missing' WHEN e <> 'yes' THEN 'has_evd_not_yes' END AS er, CASE WHEN det OR h THEN NULL WHEN a = '' THEN 'is_anchor_missing'
    WHEN a NOT IN ('yes', 'fail4_fallback') THEN 'is_anchor_not_eligible' END AS ar FROM c), g AS (SELECT segment_id, arg_min(er, pos) FILTER (WHERE er IS NOT NULL) AS er, arg_min(ar, pos) FILTER (WHERE ar IS NOT NULL) AS ar,
    CAST(count_if(det) AS BIGINT) AS detached_nodes, bool_or(h) AS has_override, bool_or(a = 'fail4_fallback' AND NOT det) AS has_fallback FROM r GROUP BY segment_id)
    SELECT segment_id, CASE WHEN er IS NOT NULL THEN 'rejected' WHEN ar IS NOT NULL THEN 'candidate' ELSE 'final' END AS state, CASE WHEN er IS NOT NULL THEN 'before_evd' WHEN ar IS NOT NULL THEN 'after_evd' END AS reject_stage,
    coalesce(er, ar) AS reject_reason, detached_nodes, has_override, has_fallback FROM g""")
def _(v):
    manual = v.supplier.select((F.col("s_suppkey") * 5 + 2).alias("node_id"))
    return RP.fusion_units(v.seg_nodes, node_states(v), manual)


@query("corridor_candidates")
def _(v):
    carriers = v.spread(v.link_roads).select(F.col("id").alias("road_id"), "pts", F.when(F.col("id") % 9 == 0, 128).otherwise(0).alias("formway"), (F.col("id") % 2 == 0).alias("linked"))
    found = RP.corridor_candidates(v.net_roads.select(F.col("id").alias("segment_id"), "pts"), carriers, 50.0, 5.0)
    return found.select("segment_id", "road_id", F.round("ratio", 4).alias("ratio"))


@query("corridor_extract", """WITH b AS (SELECT unit, road_id FROM chain_edges WHERE unit IN (SELECT (id - 1) // 8 FROM net_nodes WHERE id % 8 = 6) AND (road_id > 10000000000 OR src % 8 BETWEEN 1 AND 5)),
    t AS (SELECT unit, sum(CASE WHEN road_id < 10000000000 THEN length_m END) AS walk, sum(CASE WHEN road_id > 10000000000 THEN length_m END) AS jump FROM b JOIN chain_edges USING (unit, road_id) GROUP BY unit)
    SELECT unit, road_id, CASE WHEN jump IS NULL THEN true WHEN walk < jump THEN road_id < 10000000000 ELSE road_id > 10000000000 END AS on_path FROM b JOIN t USING (unit)""")
def _(v):
    return RP.corridor_extract(chain_edges(v), end_pairs(v))


@query("corridor_checks")
def _(v):
    edges = chain_edges(v)
    kept = edges.where("road_id % 7 != 0").select("unit", "road_id")
    required = v.net_nodes.where("id % 8 = 3").select(F.floor((F.col("id") - 1) / 8).alias("unit"), F.col("id").alias("node"))
    return RP.corridor_checks(edges, kept, end_pairs(v), required)


_WAYS = """pairs AS (SELECT (id - 1) // 8 AS unit, id AS a, id + 5 AS b FROM net_nodes WHERE id % 8 = 1 AND id + 5 <= (SELECT count(*) FROM customer)),
    f(unit, node) AS (SELECT unit, a FROM pairs UNION SELECT f.unit, e.dst FROM f JOIN chain_directed e ON e.src = f.node AND e.unit = f.unit), g(unit, node) AS (SELECT unit, b FROM pairs UNION SELECT g.unit, e.dst FROM g
    JOIN chain_directed e ON e.src = g.node AND e.unit = g.unit), w AS (SELECT p.*, f.node IS NOT NULL AS fw, g.node IS NOT NULL AS bw FROM pairs p LEFT JOIN f ON f.unit = p.unit AND f.node = p.b LEFT JOIN g ON g.unit = p.unit AND g.node = p.a)"""


@query("directed_pair_resolve", f"WITH {_WAYS} SELECT unit, CASE WHEN fw AND NOT bw THEN a WHEN bw AND NOT fw THEN b END AS source, CASE WHEN fw AND NOT bw THEN b WHEN bw AND NOT fw THEN a END AS target FROM w")
def _(v):
    return RP.resolve_direction(GR.directed_edges(chain_edges(v)), end_pairs(v))


@query("adaptive_retry", """WITH d AS (SELECT id, max(d) AS m FROM chord_distances GROUP BY id) SELECT id, m <= 10 OR (id % 3 = 0 AND m <= 18) AS passed, CASE WHEN m <= 10 THEN 'first' WHEN id % 3 = 0 AND m <= 18 THEN 'retry' ELSE 'failed' END AS round FROM d""")
def _(v):
    from ..functions import geometry as G
    measured = with_carrier(v).select("id", G.max_sampled_distance(F.col("pts"), F.col("carrier"), 10.0).alias("m"))
    first = measured.select("id", (F.col("m") <= 10).alias("passed"))
    return RP.retry_failed(first, measured.select("id", (F.col("m") <= 18).alias("passed")), "id", F.col("id") % 3 == 0)


@query("pair_anchor_retry", """WITH c AS (SELECT DISTINCT l_orderkey AS unit, l_partkey AS anchor, (l_partkey * 3 + l_orderkey) % 50 AS d FROM lineitem), p AS (SELECT c.* FROM c JOIN link_roads ON id = anchor + 1 WHERE anchor % 4 = 0)
    SELECT unit, count(*) AS passing, CASE WHEN count(*) = 1 THEN min(anchor) END AS anchor, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS state FROM p GROUP BY unit""")
def _(v):
    c = v.lineitem.select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("anchor"), ((F.col("l_partkey") * 3 + F.col("l_orderkey")) % 50).alias("dist_m")).distinct()
    return RP.retry_anchors(c, c.where("anchor % 4 = 0"))


@query("special_group_gate", "SELECT * FROM gates")
def _(v):
    return gates(v)


VIEW_SQL["plan"] = """SELECT 'segment:' || segment_id AS plan_id, segment_id, CASE WHEN segment_id % 10 = 0 THEN 'blocked' ELSE 'ready' END AS state, CASE WHEN segment_id % 10 = 0 THEN 'reverse_pair_blocked' END AS reason FROM lookup WHERE reason IS NULL
    UNION ALL SELECT 'group:' || group_id, NULL, CASE WHEN gate = 'passed' THEN 'ready' ELSE 'blocked' END, CASE WHEN gate <> 'passed' THEN 'special_group_' || gate END FROM gates"""


@query("replacement_plan", "SELECT * FROM plan")
def _(v):
    blockers = v.net_roads.where("id % 10 = 0").select(F.col("id").alias("segment_id"))
    return RP.replacement_plan(lookup(v).where("passed"), gates(v), blockers)


@query("plan_conflict_gate", """WITH o AS (SELECT road_id, arg_min(plan_id, struct_pack(p := priority, i := plan_id)) AS owner, count(*) AS n FROM plan_roads GROUP BY road_id), l AS (SELECT plan_id, count(*) AS lost_roads, count(DISTINCT owner) AS rivals
    FROM plan_roads JOIN o USING (road_id) WHERE n > 1 AND plan_id <> owner GROUP BY plan_id) SELECT p.plan_id, coalesce(lost_roads, 0) AS lost_roads, coalesce(rivals, 0) AS rivals, CASE WHEN lost_roads IS NULL THEN 'clear' ELSE 'conflict_blocked' END AS gate
    FROM (SELECT DISTINCT plan_id FROM plan_roads) p LEFT JOIN l USING (plan_id)""")
def _(v):
    return RP.plan_road_conflicts(plan_roads(v))


def mappings(v):
    return v.relations.select((F.col("target_id") * 3 + F.col("base_id")).alias("plan_id"), "target_id", "base_id", ((F.col("target_id") + F.col("base_id")) % 40).alias("gap_m"),
                              (F.col("target_id") % 2 == 0).alias("has_retained")).distinct()


@query("junction_alignment_gate", """WITH m AS (SELECT DISTINCT target_id * 3 + base_id AS plan_id, target_id, base_id, (target_id + base_id) % 40 AS gap, target_id % 2 = 0 AS has FROM relations), r AS (SELECT DISTINCT target_id, base_id FROM relations WHERE status = 0)
    SELECT plan_id, m.target_id, m.base_id, CASE WHEN gap <= 20 THEN 'aligned' WHEN r.target_id IS NOT NULL THEN 'released_by_relation' WHEN has THEN 'blocked' ELSE 'far_without_boundary' END AS state FROM m LEFT JOIN r ON r.target_id = m.target_id AND r.base_id = m.base_id""")
def _(v):
    return RP.junction_alignment_gate(mappings(v), v.relations)


@query("problem_registry", """SELECT segment_id, reason, CASE WHEN reason LIKE '%relation%' THEN 'relation' ELSE 'manual' END AS owner, CASE WHEN reason LIKE 'missing%' THEN 'complete_relation' WHEN reason LIKE '%status' THEN 'review_relation'
    ELSE 'review_segment' END AS action FROM lookup WHERE reason IS NOT NULL""")
def _(v):
    return RP.problem_registry(lookup(v))


@query("network_replace", """SELECT id, direction, 'source' AS source FROM net_roads WHERE id NOT IN (SELECT segment_id FROM lookup WHERE reason IS NULL) UNION ALL SELECT id, direction, 'carrier' FROM link_roads WHERE id IN (SELECT base_id FROM relations WHERE status = 0)""")
def _(v):
    chosen = v.relations.where("status = 0").select(F.col("base_id").alias("id"))
    return RP.replace_network(v.net_roads.select("id", "direction"), lookup(v).where("passed").select(F.col("segment_id").alias("id")), v.link_roads.select("id", "direction"), chosen)


@query("node_rebuild", """WITH RECURSIVE m AS (SELECT target_id AS a, base_id AS t FROM relation_last WHERE status = 0 AND base_id > 0 AND base_id < target_id), a AS (SELECT * FROM m UNION ALL SELECT id, mainnodeid FROM net_nodes WHERE mainnodeid IS NOT NULL
    AND mainnodeid <> id AND id NOT IN (SELECT a FROM m)), r(id, cur) AS (SELECT id, id FROM net_nodes UNION ALL SELECT r.id, a.t FROM r JOIN a ON a.a = r.cur) SELECT id, min(cur) AS mainnodeid FROM r WHERE cur NOT IN (SELECT a FROM a) GROUP BY id"""
       .replace("WITH RECURSIVE m AS", "WITH m AS"))
def _(v):
    return RP.rebuild_nodes(v.net_nodes.select("id", "mainnodeid"), relation_last(v))


def seg_states(v):
    retained = v.net_roads.where("id % 3 != 0").select(F.floor(F.col("id") / 4).alias("segment_id"))
    carriers = v.lineitem.where("l_linenumber > 5").select(F.floor(F.col("l_orderkey") / 4).alias("segment_id"))
    segments = v.net_roads.select(F.floor(F.col("id") / 4).alias("segment_id")).distinct()
    return RP.segment_relation_index(segments, retained, carriers)


VIEW_SQL["seg_states"] = """SELECT s.segment_id, coalesce(r.n, 0) AS retained, coalesce(c.n, 0) AS carriers, CASE WHEN c.n > 0 AND r.n > 0 THEN 'replaced+retained_swsd' WHEN c.n > 0 THEN 'replaced' WHEN r.n > 0 THEN 'retained_swsd' ELSE 'failed' END AS state
    FROM (SELECT DISTINCT id // 4 AS segment_id FROM net_roads) s LEFT JOIN (SELECT id // 4 AS segment_id, count(*) AS n FROM net_roads WHERE id % 3 <> 0 GROUP BY 1) r USING (segment_id)
    LEFT JOIN (SELECT l_orderkey // 4 AS segment_id, count(*) AS n FROM lineitem WHERE l_linenumber > 5 GROUP BY 1) c USING (segment_id)"""


@query("segment_relation_index", "SELECT * FROM seg_states")
def _(v):
    return seg_states(v)


@query("semantic_junction_groups", """SELECT base_id, count(*) AS targets, min(target_id) AS first_target, max(x) - min(x) AS spread_x, max(y) - min(y) AS spread_y FROM (SELECT DISTINCT target_id, base_id FROM relations WHERE status = 0 AND base_id > 0)
    JOIN net_nodes ON id = target_id GROUP BY base_id HAVING count(*) > 1""")
def _(v):
    return RP.semantic_junction_groups(v.relations, v.net_nodes)


_FINAL = "k AS (SELECT * FROM chain_edges WHERE road_id % 5 <> 0)"
VIEW_SQL["final_audit"] = """SELECT 'final_road_node_integrity' AS layer, 'road_end_without_node' AS reason, id AS object_id FROM net_roads WHERE enodeid NOT IN (SELECT id FROM net_nodes)"""


def final_roads(v):
    chain = chain_edges(v).where("road_id % 5 != 0").select("road_id", "src", "dst", F.col("unit").alias("segment_id"))
    # roads of the main network form one segment each, so only their ends are judged
    rest = v.net_roads.select((F.col("id") + 100_000_000_000).alias("road_id"), F.col("snodeid").alias("src"), F.col("enodeid").alias("dst"), (F.col("id") + 100_000_000_000).alias("segment_id"))
    return chain.unionByName(rest)


_AUDIT = """a AS (SELECT 'final_road_node_integrity' AS layer, 'road_end_without_node' AS reason, id + 100000000000 AS object_id FROM net_roads WHERE enodeid NOT IN (SELECT id FROM net_nodes) UNION ALL
    SELECT 'segment_internal_connectivity', 'segment_in_several_parts', unit FROM (SELECT e.unit, count(DISTINCT component) AS n FROM (SELECT DISTINCT unit, src FROM chain_edges WHERE road_id % 5 <> 0) e JOIN comp ON node = src GROUP BY 1) WHERE n > 1)"""


def audit_rows(v):
    roads = final_roads(v)
    return RP.topology_audit(roads, v.net_nodes.select(F.col("id").alias("node")), roads.select("segment_id").distinct())


@query("topology_audit", f"WITH {components_sql('WHERE road_id % 5 <> 0')}, {_AUDIT} SELECT * FROM a")
def _(v):
    return audit_rows(v)


@query("final_topology_metric", f"""WITH {components_sql('WHERE road_id % 5 <> 0')}, {_AUDIT} SELECT CASE WHEN layer = 'final_road_node_integrity' THEN 'independent_attachment' ELSE 'segment_transition' END AS category, count(*) AS fail_rows,
    count(DISTINCT (layer, object_id, reason)) AS fail_objects FROM a GROUP BY 1""")
def _(v):
    return RP.topology_metric(audit_rows(v))


@query("rollback_rounds", """WITH r(plan_id, n) AS (SELECT id, 0 FROM net_nodes WHERE id % 16 = 3 UNION SELECT snodeid, n + 1 FROM r JOIN net_chain_roads ON enodeid = plan_id) SELECT p.id AS plan_id, CASE WHEN r.n IS NULL THEN 'applied' ELSE 'rolled_back' END AS state,
    min(r.n) AS round_no FROM net_nodes p LEFT JOIN r ON r.plan_id = p.id GROUP BY ALL""")
def _(v):
    plans = v.net_nodes.select(F.col("id").alias("plan_id"), (F.col("id") % 16 == 3).alias("fails"))
    return RP.rollback_rounds(plans, v.net_chain_roads.select(F.col("snodeid").alias("plan_id"), F.col("enodeid").alias("needs")))


@query("coverage_fallback", """SELECT id, round(count_if(d <= 5) / CAST(count(*) AS DOUBLE), 6) AS ratio, round(count_if(d <= 5) / CAST(count(*) AS DOUBLE), 6) < 0.9 AS retain_source FROM chord_distances GROUP BY id""")
def _(v):
    return RP.coverage_fallback(with_carrier(v), 5.0)


@query("uncovered_metrics", """SELECT id, round(total * (1 - s), 4) AS uncovered_m, round(1 - s, 6) AS uncovered_ratio FROM (SELECT id, count_if(d <= 5) / CAST(count(*) AS DOUBLE) AS s FROM chord_distances GROUP BY id) JOIN road_length USING (id)""")
def _(v):
    return RP.uncovered_metrics(with_carrier(v), 5.0)


def advance_rights(v):
    return v.net_roads.where("formway = 128").select(F.col("id").alias("road_id"), F.floor(F.col("snodeid") / 4).alias("from_segment"), F.floor(F.col("enodeid") / 4).alias("to_segment"), F.col("snodeid").alias("src"), F.col("enodeid").alias("dst"))


VIEW_SQL["contract"] = """SELECT id AS road_id, snodeid, enodeid, CASE WHEN a.state IS NULL OR b.state IS NULL THEN 'audit_missing_neighbour' WHEN a.state LIKE 'replaced%' AND b.state LIKE 'replaced%' THEN 'use_carrier'
    WHEN a.state LIKE 'replaced%' OR b.state LIKE 'replaced%' THEN 'attach_source_to_carrier' ELSE 'retain_source' END AS choice FROM net_roads LEFT JOIN seg_states a ON a.segment_id = snodeid // 4 LEFT JOIN seg_states b ON b.segment_id = enodeid // 4
    WHERE formway = 128"""


@query("advance_right_contract", "SELECT road_id, choice FROM contract")
def _(v):
    return RP.advance_right_contract(advance_rights(v), seg_states(v))


@query("unreplaced_attribution", """SELECT l_orderkey % 1000 AS b, CASE WHEN l_linenumber % 2 = 0 AND l_returnflag <> 'A' THEN '5_replaceable_scope_unreplaced' WHEN l_returnflag <> 'N' AND l_linenumber % 3 <> 0 THEN '4_relation_scope_not_replaceable'
    WHEN l_linestatus = 'O' AND l_returnflag = 'N' THEN '3_evidence_scope_no_relation' WHEN l_quantity > 10 AND l_linestatus <> 'O' THEN '2_swsd_scope_no_t06_evidence' WHEN l_quantity <= 10 THEN '1_outside_swsd_scope' ELSE '6_manual_audit' END AS attribution_class,
    count(*) AS n FROM lineitem GROUP BY ALL""")
def _(v):
    f, n = F.col("l_returnflag"), F.col("l_linenumber")
    rows = v.lineitem.select((F.col("l_orderkey") % 1000).alias("b"), (n % 2 == 0).alias("planned"), (f == "A").alias("applied"), (f != "N").alias("has_relation"), (n % 3 == 0).alias("replaceable"),
                             (F.col("l_linestatus") == "O").alias("has_evidence"), (F.col("l_quantity") > 10).alias("in_scope"))
    return RP.unreplaced_attribution(rows).groupBy("b", "attribution_class").agg(F.count("*").alias("n"))


@query("road_ownership", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY tight DESC, broad DESC, dist, segment_id) AS rn, rank() OVER (PARTITION BY road_id ORDER BY tight DESC, broad DESC, dist) AS rk FROM owner_scores)
    SELECT road_id, max(CASE WHEN rn = 1 THEN segment_id END) AS owner_id, max(CASE WHEN rn = 1 THEN tight END) AS tight FROM r GROUP BY road_id HAVING count(*) FILTER (WHERE rk = 1) = 1""")
def _(v):
    from .windows import owner_scores
    return road_owners(owner_scores(v)).where("NOT ambiguous").select("road_id", "owner_id", "tight")


@query("buffer_diagnostics", """SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 7 = 0 THEN 'carrier_network_gap' WHEN o_orderkey % 5 = 0 THEN 'buffer_scope_too_narrow' WHEN o_orderkey % 4 = 0 THEN 'carrier_direction_gap' WHEN o_orderkey % 3 = 0
    THEN 'candidate_direction_gap' ELSE 'geometry_check_failed' END AS root_cause FROM orders WHERE o_orderstatus <> 'F'""")
def _(v):
    o = F.col("o_orderkey")
    checks = v.orders.select(o.alias("unit"), (F.col("o_orderstatus") == "F").alias("passed"), (o % 7 != 0).alias("full_connected"), (o % 5 != 0).alias("candidate_connected"), (o % 4 != 0).alias("full_directed"), (o % 3 != 0).alias("candidate_directed"))
    return RP.buffer_diagnostics(checks)


@query("pair_anchor_diagnostics", """SELECT segment_id AS unit, CASE WHEN a NOT IN (SELECT target_id FROM relations WHERE status = 0) AND b NOT IN (SELECT target_id FROM relations WHERE status = 0) THEN 'both' WHEN a NOT IN (SELECT target_id FROM relations WHERE status = 0)
    THEN 'start' WHEN b NOT IN (SELECT target_id FROM relations WHERE status = 0) THEN 'end' ELSE 'none' END AS wrong_end FROM (SELECT segment_id, max(CASE WHEN pos = 0 THEN node_id END) AS a, max(CASE WHEN pos = 1 THEN node_id END) AS b FROM seg_nodes GROUP BY 1)""")
def _(v):
    ends = v.seg_nodes.groupBy(F.col("segment_id").alias("unit")).agg(F.max(F.when(F.col("pos") == 0, F.col("node_id"))).alias("a"), F.max(F.when(F.col("pos") == 1, F.col("node_id"))).alias("b"))
    return RP.pair_anchor_diagnostics(ends, v.relations.where("status = 0").select(F.col("target_id").alias("node")))


@query("attach_promotion", """WITH a AS (SELECT l_partkey AS road_id, count(DISTINCT l_orderkey) AS askers, min(l_orderkey) AS asker FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), h AS (SELECT l_partkey AS road_id, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem
    WHERE l_linenumber = 7 GROUP BY 1), s AS (SELECT a.road_id, asker, CASE WHEN askers > 1 THEN 'several_askers' WHEN coalesce(lo <> asker OR hi <> asker, false) THEN 'owned_by_other' ELSE 'promoted' END AS state FROM a LEFT JOIN h USING (road_id))
    SELECT road_id, state, CASE WHEN state = 'promoted' THEN asker END AS segment_id FROM s""")
def _(v):
    rows = v.lineitem.select(F.col("l_partkey").alias("road_id"), F.col("l_orderkey").alias("segment_id"), "l_linenumber")
    return RP.attach_promotion(rows.where("l_linenumber = 1"), rows.where("l_linenumber = 7"))


@query("lost_attach_roads", """WITH k AS (SELECT * FROM chain_edges WHERE road_id % 4 <> 0), n AS (SELECT DISTINCT unit, unnest([src, dst]) AS node FROM k) SELECT DISTINCT n.unit, e.road_id FROM n JOIN (SELECT road_id, unnest([src, dst]) AS node FROM chain_edges) e
    USING (node) WHERE (n.unit, e.road_id) NOT IN (SELECT (unit, road_id) FROM k)""")
def _(v):
    edges = chain_edges(v)
    return RP.lost_attach_roads(edges, edges.where("road_id % 4 != 0"))


@query("bidirectional_reality")
def _(v):
    edges = chain_edges(v)
    return RP.bidirectional_reality(GR.directed_edges(edges), GR.both_ways(edges), end_pairs(v))


@query("semantic_endpoint_retry", """WITH pairs AS (SELECT (id - 1) // 8 AS unit, id AS a, id + 5 AS b FROM net_nodes WHERE id % 8 = 1 AND id + 5 <= (SELECT count(*) FROM customer)), d AS (SELECT unit, src, dst FROM chain_edges WHERE direction <> 3 OR formway & 128 <> 0 UNION
    SELECT unit, dst, src FROM chain_edges WHERE direction <> 2 OR formway & 128 <> 0), f(unit, node) AS (SELECT unit, a FROM pairs UNION SELECT f.unit, d.dst FROM f JOIN d ON d.unit = f.unit AND d.src = f.node)
    SELECT p.unit, a, b, CASE WHEN f.node IS NOT NULL THEN 'passed_by_advance_right' ELSE 'failed' END AS state FROM pairs p LEFT JOIN f ON f.unit = p.unit AND f.node = p.b""")
def _(v):
    edges = chain_edges(v).select("unit", "road_id", "src", "dst", "direction", "formway")
    extra = edges.where(F.col("formway").bitwiseAND(128) != 0).withColumn("direction", F.lit(0))
    return RP.semantic_endpoint_retry(end_pairs(v), edges, extra)


@query("construction_class", """SELECT o_orderkey AS segment_id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN '2a_complete' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 1 AND o_orderkey % 5 = 0 THEN '2b_main_complete_side_missing' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 1
    THEN '2c_not_replaceable' WHEN o_orderkey % 7 = 0 THEN 'pair_incomplete' WHEN o_orderkey % 11 = 0 THEN 'pair_only' ELSE '2c_not_replaceable' END AS construction_class FROM orders""")
def _(v):
    o = F.col("o_orderkey")
    rows = v.orders.select(o.alias("segment_id"), (o % 2 == 0).alias("is_replaceable"), F.when(o % 3 == 0, "replaced").when(o % 3 == 1, "replaced+retained_swsd").otherwise("retained_swsd").alias("relation_status"),
                           F.when(o % 5 == 0, "missing").otherwise("complete").alias("side_status"), F.when(o % 7 == 0, "partial").otherwise("complete").alias("pair_status"), F.when(o % 11 == 0, "partial").otherwise("complete").alias("junc_status"))
    return RP.construction_class(rows)


@query("group_assignments", f"""WITH {components_sql('WHERE formway & 128 <> 0')} SELECT component, count(*) AS segments, arg_min(node, struct_pack(p := node * 31 % 53, n := node)) AS leader FROM comp GROUP BY component HAVING count(*) > 1""")
def _(v):
    members = chain_edges(v).where(F.col("formway").bitwiseAND(128) != 0).select("road_id", F.explode(F.array("src", "dst")).alias("segment_id"))
    return RP.group_assignments(members, members.select("segment_id").distinct().withColumn("priority", F.col("segment_id") * 31 % 53))


@query("endpoint_nodes_supplement", """SELECT node, node IN (SELECT id FROM net_nodes) AS found FROM (SELECT snodeid AS node FROM net_roads UNION SELECT enodeid FROM net_roads) WHERE node NOT IN (SELECT id FROM net_nodes WHERE id % 3 <> 0)""")
def _(v):
    roads = v.net_roads.select(F.col("snodeid").alias("src"), F.col("enodeid").alias("dst"))
    return RP.supplement_end_nodes(roads, v.net_nodes.where("id % 3 != 0").select(F.col("id").alias("node")), node_kinds(v))


@query("node_map_backfill", """WITH a AS (SELECT node_id, min(base_id) AS b FROM (SELECT target_id AS node_id, base_id FROM relations WHERE status = 0) GROUP BY 1 HAVING min(base_id) = max(base_id)) SELECT segment_id, s.node_id, coalesce(CASE WHEN s.pos < 2 THEN segment_id END, a.b) AS base_id,
    s.pos >= 2 AND a.b IS NOT NULL AS filled FROM seg_nodes s LEFT JOIN a USING (node_id)""")
def _(v):
    maps = v.seg_nodes.select("segment_id", "node_id", F.when(F.col("pos") < 2, F.col("segment_id")).alias("base_id"))
    return RP.backfill_node_map(maps, v.relations.where("status = 0").select(F.col("target_id").alias("node_id"), "base_id"))


@query("transition_closure", """WITH m AS (SELECT o_orderkey + 1 AS segment_id, o_orderkey * 5 AS node_id FROM orders UNION ALL SELECT o_orderkey + 1, o_orderkey * 5 + 5 * (1 + o_orderkey % 3) FROM orders),
    rb AS (SELECT segment_id FROM lookup WHERE reason IS NOT NULL), o AS (SELECT node_id FROM m WHERE segment_id IN (SELECT * FROM rb) GROUP BY node_id HAVING count(DISTINCT segment_id) = 1)
    SELECT DISTINCT segment_id FROM m WHERE node_id IN (SELECT * FROM o) AND segment_id NOT IN (SELECT * FROM rb) AND segment_id % 2 = 0""")
def _(v):
    o = F.col("o_orderkey")
    ends = v.orders.select((o + 1).alias("segment_id"), F.explode(F.array(o * 5, o * 5 + 5 * (1 + o % 3))).alias("node_id"))
    return RP.transition_closure(lookup(v).where("NOT passed").select("segment_id"), ends, v.net_roads.where("id % 2 = 0").select(F.col("id").alias("segment_id")))


@query("surface_release", """WITH m AS (SELECT target_id, base_id, target_id // 2 AS plan_id, CASE WHEN target_id // 2 % 3 = 0 THEN 'ready' ELSE 'blocked' END AS state FROM (SELECT DISTINCT target_id, base_id FROM relation_last)), r AS (SELECT DISTINCT target_id, base_id FROM relations WHERE status = 0)
    SELECT plan_id, CASE WHEN state = 'blocked' AND bool_and(r.target_id IS NOT NULL) THEN 'released' ELSE state END AS state FROM m LEFT JOIN r ON r.target_id = m.target_id AND r.base_id = m.base_id GROUP BY plan_id, state""")
def _(v):
    plan_id = F.floor(F.col("target_id") / 2)
    plan = relation_last(v).select("target_id", "base_id", plan_id.alias("plan_id"), F.when(plan_id % 3 == 0, "ready").otherwise("blocked").alias("state"))
    return RP.release_blocked(plan, v.relations)


@query("surface_topology_rows", """SELECT s.surface_id, coalesce(h.n, 0) AS junctions, CASE WHEN h.n IS NULL THEN 'surface_without_junction' WHEN h.n > 1 THEN 'several_junctions' END AS blocking_reason FROM surfaces s LEFT JOIN (SELECT surface_id, count(*) AS n FROM net_nodes n JOIN surfaces s
    ON n.x BETWEEN x0 AND x1 AND n.y BETWEEN y0 AND y1 GROUP BY 1) h USING (surface_id)""")
def _(v):
    hits = surface_hits(v).select(F.col("ring_id").alias("surface_id"), F.col("p_id").alias("node"))
    return RP.surface_topology_rows(v.net_nodes, v.surfaces, hits)


@query("special_internal_replace", f"""WITH {components_sql('WHERE roadtype & 8 <> 0')} SELECT DISTINCT a.component AS group_id, e.road_id FROM chain_edges e JOIN comp a ON a.node = src JOIN comp b ON b.node = dst AND b.component = a.component WHERE a.component % 3 = 0""")
def _(v):
    from ..plans.preprocess import roundabout_nodes
    ring = roundabout_nodes(chain_edges(v)).select(F.col("mainnodeid").alias("group_id"), "node")
    groups = ring.select("group_id").distinct().withColumn("gate", F.when(F.col("group_id") % 3 == 0, "passed").otherwise("partial"))
    return RP.special_internal_roads(chain_edges(v), groups, ring)


@query("advance_right_postprocess", """WITH m AS (SELECT target_id AS node, base_id FROM relation_last WHERE status = 0) SELECT road_id, coalesce(a.base_id, snodeid) AS src, coalesce(b.base_id, enodeid) AS dst, a.base_id IS NOT NULL OR b.base_id IS NOT NULL AS attached
    FROM contract LEFT JOIN m a ON a.node = snodeid LEFT JOIN m b ON b.node = enodeid WHERE choice = 'attach_source_to_carrier'""")
def _(v):
    roads = advance_rights(v)
    mapped = relation_last(v).where("status = 0").select(F.col("target_id").alias("node"), F.col("base_id").alias("carrier_node"))
    return RP.advance_right_postprocess(roads.select("road_id", "src", "dst"), RP.advance_right_contract(roads, seg_states(v)), mapped)


@query("attachment_status", """SELECT id AS attachment_id, split_part(s, ':', 1) AS status, split_part(s, ':', 2) AS reason FROM (SELECT id, CASE WHEN id % 23 = 0 THEN 'fail:node_id_missing' WHEN enodeid NOT IN (SELECT id FROM net_nodes) THEN 'fail:node_missing' WHEN id % 4 > 1 AND id % 9 = 0
    THEN 'fail:nodes_not_coincident' WHEN id % 7 = 0 THEN 'fail:carrier_node_isolated' WHEN id % 5 <> id % 3 THEN CASE WHEN id % 2 = 0 THEN 'warn:merged_to_alternate' ELSE 'fail:mainnode_not_merged' END ELSE 'pass:connected' END AS s FROM net_roads)""")
def _(v):
    i = F.col("id")
    nodes = v.net_nodes.select(F.col("id").alias("enodeid"), F.lit(True).alias("_e"))
    rows = v.net_roads.join(nodes, "enodeid", "left").select(
        i.alias("attachment_id"), F.when(i % 23 != 0, F.col("snodeid")).alias("source_node"), F.col("enodeid").alias("carrier_node"), F.coalesce("_e", F.lit(False)).alias("carrier_exists"),
        F.when(i % 9 == 0, i % 4).otherwise(0).alias("gap_m"), (i % 7 != 0).alias("carrier_incident"), (i % 5).alias("source_main"), (i % 3).alias("carrier_main"), (i % 2 == 0).alias("alternate"))
    return RP.attachment_status(rows)
