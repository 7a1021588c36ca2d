"""Checks of published networks and of the evidence behind them."""
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import graph as GR
from ..operators import joins as J
from ..plans import checks as C
from .anchors import anchor_result
from .graphs import chain_edges, components_sql
from .joins import canon_roads
from .registry import query
from .views import VIEW_SQL

_BOX = "sqrt(pow(greatest(x0 - x, x - x1, 0), 2) + pow(greatest(y0 - y, y - y1, 0), 2))"


def groups(v):
    return J.canonical_nodes(v.net_nodes).select("node_id", F.col("canonical_id").alias("junction_id"))


@query("t07_truth_check", f"""WITH o AS (SELECT c.canonical_id AS junction_id, count(*) AS n, min(surface_id) AS s FROM (SELECT DISTINCT canonical_id FROM canon) c JOIN net_nodes p ON p.id = c.canonical_id
    JOIN surfaces ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY 1), m AS (SELECT DISTINCT canonical_id AS junction_id FROM canon JOIN net_nodes ON id = node_id
    JOIN surfaces ON x BETWEEN x0 - 5 AND x1 + 5 AND y BETWEEN y0 - 5 AND y1 + 5 WHERE {_BOX} <= 5)
    SELECT g.junction_id, coalesce(n, 0) AS surfaces, CASE WHEN n = 1 THEN s END AS surface_id, m.junction_id IS NOT NULL AS matched, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS state
    FROM (SELECT DISTINCT canonical_id AS junction_id FROM canon) g LEFT JOIN o USING (junction_id) LEFT JOIN m USING (junction_id)""")
def _(v):
    return C.truth_surfaces(groups(v), v.net_nodes, v.surfaces.select(F.col("surface_id").alias("ring_id"), "ring"), 5.0)


VIEW_SQL["segment_ends"] = """SELECT id AS portal_id, src AS junction_id, 'source' AS role, xs[1] AS px, ys[1] AS py FROM canon_roads UNION ALL SELECT id, dst, 'target', xs[4], ys[4] FROM canon_roads"""


def segment_ends(v):
    end = F.explode(F.array(F.struct(F.lit("source").alias("role"), F.col("src").alias("junction_id"), F.col("pts")[0].alias("p")),
                            F.struct(F.lit("target").alias("role"), F.col("dst").alias("junction_id"), F.element_at("pts", -1).alias("p")))).alias("e")
    return canon_roads(v).select(F.col("id").alias("portal_id"), end).select("portal_id", "e.role", "e.junction_id", "e.p.x", "e.p.y")


@query("anchor_portals", """WITH d AS (SELECT src, dst FROM canon_roads WHERE direction <> 3 UNION ALL SELECT dst, src FROM canon_roads WHERE direction <> 2), u AS (SELECT DISTINCT 'source' AS role, src AS c FROM d UNION SELECT 'target', dst FROM d),
    raw AS (SELECT id, canonical_id AS c, x, y FROM net_nodes JOIN canon ON node_id = id),
    a AS (SELECT portal_id, role, c, id, sqrt((px - x) * (px - x) + (py - y) * (py - y)) AS dist, 0 AS s FROM segment_ends JOIN raw ON c = junction_id UNION ALL
          SELECT portal_id, role, c, id, sqrt((px - x) * (px - x) + (py - y) * (py - y)), 1 FROM segment_ends JOIN raw ON x BETWEEN px - 50 AND px + 50 AND y BETWEEN py - 50 AND py + 50 WHERE (px - x) * (px - x) + (py - y) * (py - y) <= 2500),
    b AS (SELECT portal_id, role, c, min(struct_pack(d := dist, s := s, i := id)) AS m FROM a JOIN u USING (role, c) GROUP BY ALL)
    SELECT portal_id, role, c AS canonical_id, m.i AS raw_id, round(m.d, 6) AS distance_m, CASE WHEN m.s = 0 THEN 'grouped_relation' ELSE 'spatial_portal' END AS source FROM b""")
def _(v):
    nodes = v.net_nodes.select("id", "x", "y").join(groups(v).select(F.col("node_id").alias("id"), F.col("junction_id").alias("canonical_id")), "id")
    edges = GR.directed_edges(canon_roads(v).select("src", "dst", "direction"))
    return C.portal_candidates(segment_ends(v), groups(v), nodes, edges, 50.0).withColumn("distance_m", rounded(F.col("distance_m")))


@query("continuity_audit", """WITH e AS (SELECT id AS road_id, (id - 1) // 4 AS segment_id, 'start' AS endpoint, src AS node, xs[1] AS px, ys[1] AS py FROM canon_roads UNION ALL SELECT id, (id - 1) // 4, 'end', dst, xs[4], ys[4] FROM canon_roads),
    d AS (SELECT node, count(*) AS incident FROM e GROUP BY 1), a AS (SELECT DISTINCT segment_id, node_id AS node FROM seg_nodes WHERE role = 'pair'),
    r AS (SELECT e.segment_id, road_id, endpoint, e.node, incident, a.node IS NOT NULL AS at_access, coalesce(sqrt((px - x) * (px - x) + (py - y) * (py - y)), 0) AS s FROM e JOIN d ON d.node = e.node LEFT JOIN net_nodes n ON n.id = e.node LEFT JOIN a ON a.segment_id = e.segment_id AND a.node = e.node)
    SELECT segment_id, road_id, endpoint, node, incident, at_access, round(s, 6) AS shift_m, CASE WHEN incident <= 1 AND NOT at_access THEN 'built_endpoint_unconnected' WHEN s > 60 + 1e-9 THEN 'built_endpoint_shift_exceeds_limit' ELSE 'built_endpoint_continuity_pass' END AS reason FROM r""")
def _(v):
    roads = canon_roads(v).select(F.col("id").alias("road_id"), F.floor((F.col("id") - 1) / 4).alias("segment_id"), "src", "dst", "pts")
    accesses = v.seg_nodes.where("role = 'pair'").select("segment_id", F.col("node_id").alias("node"))
    return C.built_end_continuity(roads, v.net_nodes, accesses, 60.0).withColumn("shift_m", rounded(F.col("shift_m")))


@query("portal_clusters", """WITH e AS (SELECT a.id AS a, b.id AS b FROM net_nodes a JOIN net_nodes b ON b.x BETWEEN a.x - 12 AND a.x + 12 AND b.y BETWEEN a.y - 12 AND a.y + 12 AND a.id <> b.id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144),
    r(node, other) AS (SELECT id, id FROM net_nodes UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other) SELECT node AS p_id, min(other) AS cluster FROM r GROUP BY node""")
def _(v):
    return C.portal_clusters(v.net_nodes.select(F.col("id").alias("p_id"), "x", "y"), 12.0)


_LENGTH = " + ".join(f"sqrt((xs[{i + 1}] - xs[{i}]) * (xs[{i + 1}] - xs[{i}]) + (ys[{i + 1}] - ys[{i}]) * (ys[{i + 1}] - ys[{i}]))" for i in (1, 2, 3))


@query("directional_topology", f"""WITH l AS (SELECT *, round(least(10, {_LENGTH}), 6) AS arm_m FROM canon_roads) SELECT id || ':s' AS portal_id, id AS road_id, 's' AS endpoint, 'outgoing' AS flow_role, src AS junction_id, xs[1] AS x, ys[1] AS y, arm_m FROM l
    UNION ALL SELECT id || ':e', id, 'e', 'incoming', dst, xs[4], ys[4], arm_m FROM l""")
def _(v):
    roads = canon_roads(v).select(F.col("id").alias("road_id"), "src", "dst", "pts")
    return C.directional_portals(roads, 10.0).withColumn("arm_m", rounded(F.col("arm_m")))


@query("alignment_verdict", """WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'semantic_junction' WHEN 'R' THEN 'junction_partial' ELSE CASE WHEN l_linenumber = 1 THEN 'ambiguous' WHEN l_linenumber > 5 THEN 'none' ELSE 'road_only' END END AS k,
    CASE WHEN l_quantity > 30 THEN 'A' WHEN l_quantity > 10 THEN 'B' ELSE 'C' END AS lv, l_tax >= 0.08 AS inv, l_linestatus = 'O' AS ok FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN k = 'ambiguous' THEN 'blocked' WHEN k = 'none' THEN 'not_applicable' WHEN inv THEN 'inconsistent' WHEN k = 'semantic_junction' AND lv = 'A' THEN 'strong_consistent'
    WHEN k = 'junction_partial' OR k = 'semantic_junction' AND lv = 'B' THEN 'partial_consistent' WHEN k = 'road_only' AND ok THEN 'direction_only_consistent' ELSE 'inconsistent' END AS verdict FROM t""")
def _(v):
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    kind = F.when(F.col("l_returnflag") == "A", "semantic_junction").when(F.col("l_returnflag") == "R", "junction_partial").when(n == 1, "ambiguous").when(n > 5, "none").otherwise("road_only")
    level = F.when(q > 30, "A").when(q > 10, "B").otherwise("C")
    return v.lineitem.select("l_orderkey", "l_linenumber", C.alignment_verdict(kind, level, F.col("l_tax") >= 0.08, F.col("l_linestatus") == "O").alias("verdict"))


@query("review_task_status", """WITH t AS (SELECT o_custkey AS target_id, o_orderpriority AS source_table, o_orderkey AS row_order, CASE o_orderstatus WHEN 'F' THEN 'no_valid_relation' WHEN 'O' THEN CASE WHEN o_totalprice > 200000 THEN 'uncertain' ELSE '' END ELSE 'one_to_one' END AS k,
    CASE WHEN o_orderpriority < '2' THEN 'null' WHEN o_orderpriority < '4' THEN CAST(o_custkey AS VARCHAR) ELSE ' ' END AS ids, CASE WHEN o_totalprice < 100000 THEN 'seen' END AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders)
    SELECT target_id, source_table, row_order, CASE WHEN k = 'no_valid_relation' AND ids = 'null' THEN 'NULL' WHEN k = 'uncertain' THEN 'uncertain' WHEN k <> '' AND ids NOT IN (' ', 'null') THEN 'filled' WHEN k <> '' OR ids <> ' ' OR c IS NOT NULL THEN 'partial' ELSE 'blank' END AS status FROM t WHERE rn = 1""")
def _(v):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    kind = F.when(s == "F", "no_valid_relation").when(s != "O", "one_to_one").when(F.col("o_totalprice") > 200000, "uncertain").otherwise("")
    ids = F.when(p < "2", "null").when(p < "4", F.col("o_custkey").cast("string")).otherwise(" ")
    return C.review_tasks(v.orders.select(F.col("o_custkey").alias("target_id"), p.alias("source_table"), F.col("o_orderkey").alias("row_order"), kind.alias("manual_type"), ids.alias("selected_ids"),
                                          F.when(F.col("o_totalprice") < 100000, "seen").alias("comment")))


VIEW_SQL["event_candidates"] = """SELECT DISTINCT l_orderkey AS unit, l_partkey * 10 + l_linenumber AS candidate_id, l_linenumber % 4 AS pool_rank, l_suppkey % 3 AS layer, CAST(l_quantity AS INTEGER) * 3 AS priority, l_suppkey % 2 AS zone_rank, l_linenumber = 2 AS selected FROM lineitem"""


@query("candidate_shortlist", """WITH b AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY selected DESC, pool_rank, layer, priority DESC, candidate_id) AS rank_no FROM event_candidates QUALIFY rank_no <= 4)
    SELECT b.unit, b.candidate_id, CAST(b.rank_no AS INTEGER) AS rank_no, CASE WHEN o.unit IS NULL THEN '' WHEN o.pool_rank < s.pool_rank THEN 'higher_raw_rank_rejected_in_case_reselection' WHEN o.layer < s.layer THEN 'higher_layer_alternative_exists'
    WHEN o.layer = s.layer AND o.zone_rank > s.zone_rank AND o.priority >= s.priority - 60 THEN 'same_layer_alternative_closer_to_throat_or_middle' WHEN o.layer = s.layer AND o.priority > s.priority + 40 THEN 'same_layer_priority_gap' ELSE '' END AS signal
    FROM b JOIN b s ON s.unit = b.unit AND s.rank_no = 1 LEFT JOIN b o ON o.unit = b.unit AND o.rank_no = 2""")
def _(v):
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    rows = v.lineitem.select(F.col("l_orderkey").alias("unit"), (F.col("l_partkey") * 10 + n).alias("candidate_id"), (n % 4).alias("pool_rank"), (s % 3).alias("layer"),
                             (F.col("l_quantity").cast("int") * 3).alias("priority"), (s % 2).alias("zone_rank"), (n == 2).alias("selected")).distinct()
    return C.shortlist(rows)


@query("business_connectivity", f"""WITH {components_sql()}, e2 AS (SELECT src, dst FROM chain_edges WHERE formway = 0 UNION SELECT dst, src FROM chain_edges WHERE formway = 0),
    r2(node, other) AS (SELECT src, src FROM e2 UNION SELECT r2.node, e2.dst FROM r2 JOIN e2 ON e2.src = r2.other), c2 AS (SELECT node, min(other) AS component FROM r2 GROUP BY node),
    t AS (SELECT (id - 1) // 8 AS unit, id AS node, c.component AS a, d.component AS b FROM net_nodes LEFT JOIN comp c ON c.node = id LEFT JOIN c2 d ON d.node = id WHERE id % 8 NOT IN (0, 3)),
    p AS (SELECT x.unit, CAST(count_if(x.a = y.a AND x.b <> y.b) AS BIGINT) AS split_pairs, CAST(count_if(x.a <> y.a AND x.b = y.b) AS BIGINT) AS joined_pairs FROM t x JOIN t y ON x.unit = y.unit AND x.node < y.node GROUP BY 1),
    n AS (SELECT unit, count(*) AS terminals, CAST(count_if(b IS NULL) AS BIGINT) AS missing, count_if(a IS NULL) AS unseen FROM t GROUP BY 1)
    SELECT unit, terminals, missing, coalesce(split_pairs, 0) AS split_pairs, coalesce(joined_pairs, 0) AS joined_pairs, unseen = 0 AND missing = 0 AND coalesce(split_pairs, 0) = 0 AND coalesce(joined_pairs, 0) = 0 AS equivalent FROM n LEFT JOIN p USING (unit)""")
def _(v):
    edges = chain_edges(v)
    terminals = v.net_nodes.where(~(F.col("id") % 8).isin(0, 3)).select(F.floor((F.col("id") - 1) / 8).alias("unit"), F.col("id").alias("node"))
    return C.terminal_partitions(edges, edges.where("formway = 0"), terminals)


@query("profile_slice", """WITH k AS (SELECT id FROM net_nodes ORDER BY (x - 300) * (x - 300) + (y - 700) * (y - 700), id LIMIT 100) SELECT id FROM canon_roads WHERE src IN (SELECT id FROM k) OR dst IN (SELECT id FROM k)""")
def _(v):
    return C.profile_slice(v.net_nodes, canon_roads(v).select("id", "src", "dst"), 300.0, 700.0, 100)


@query("segment_slice")
def _(v):
    lines = v.net_roads.select(F.col("id").alias("line_id"), "pts")
    chosen = v.supplier.where("s_nationkey = 3").select((F.col("s_suppkey") + 1).alias("line_id"))
    return C.segment_slice(lines.join(chosen, "line_id", "left_semi"), lines, 200.0)


@query("endpoint_override", """WITH o AS (SELECT l_orderkey + 1 AS road_id, CASE WHEN l_linenumber % 2 = 1 THEN 'start' ELSE 'end' END AS endpoint, min(l_partkey + 1) AS node_id FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL),
    k AS (SELECT o.*, n.id IS NOT NULL AS known FROM o LEFT JOIN net_nodes n ON n.id = node_id)
    SELECT r.id, CASE WHEN s.known THEN s.node_id ELSE snodeid END AS snodeid, CASE WHEN e.known THEN e.node_id ELSE enodeid END AS enodeid,
    CASE WHEN s.road_id IS NULL THEN 'kept' WHEN NOT s.known THEN 'unknown_node' WHEN s.node_id = snodeid THEN 'no_change' ELSE 'applied' END AS start_state,
    CASE WHEN e.road_id IS NULL THEN 'kept' WHEN NOT e.known THEN 'unknown_node' WHEN e.node_id = enodeid THEN 'no_change' ELSE 'applied' END AS end_state
    FROM net_roads r LEFT JOIN k s ON s.road_id = r.id AND s.endpoint = 'start' LEFT JOIN k e ON e.road_id = r.id AND e.endpoint = 'end'""")
def _(v):
    overrides = v.lineitem.select((F.col("l_orderkey") + 1).alias("road_id"), F.when(F.col("l_linenumber") % 2 == 1, "start").otherwise("end").alias("endpoint"),
                                  (F.col("l_partkey") + 1).alias("node_id"), (F.col("l_returnflag") == "A").alias("confirmed"))
    return C.override_ends(v.net_roads, v.net_nodes, overrides)


@query("nodes_state_update", """WITH n AS (SELECT id, coalesce(nullif(mainnodeid, 0), id) = id AS rep, CASE WHEN closed_con = 1 THEN 'no' END AS was FROM net_nodes), x AS (SELECT n.*, CASE WHEN rep THEN coalesce(r.is_anchor, was) ELSE was END AS v FROM n LEFT JOIN anchor_result r ON r.junction_id = n.id)
    SELECT id, v AS is_anchor, was, v IS DISTINCT FROM was AS changed FROM x""")
def _(v):
    nodes = v.net_nodes.select("id", "mainnodeid", F.when(F.col("closed_con") == 1, "no").alias("is_anchor"))
    return C.write_node_states(nodes, anchor_result(v).select("junction_id", F.col("is_anchor").alias("state")))


@query("geometry_quality")
def _(v):
    return C.geometry_flags(v.net_roads, 120.0, 5.0, 3.0)


@query("independent_quality", f"""SELECT 'end_without_node' AS violation, id FROM net_roads WHERE snodeid NOT IN (SELECT id FROM net_nodes) OR enodeid NOT IN (SELECT id FROM net_nodes) UNION ALL
    SELECT 'node_without_road', id FROM net_nodes WHERE id NOT IN (SELECT snodeid FROM net_roads UNION SELECT enodeid FROM net_roads) UNION ALL SELECT 'repeated_road_id', id FROM net_roads GROUP BY id HAVING count(*) > 1 UNION ALL
    SELECT 'loop', id FROM net_roads WHERE snodeid = enodeid UNION ALL SELECT 'line_without_length', id FROM net_roads WHERE {_LENGTH} = 0""")
def _(v):
    return C.published_violations(v.net_roads, v.net_nodes)
