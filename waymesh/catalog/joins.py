"""Key, place and range joins."""
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalar import rounded
from ..operators import joins as J
from ..operators import spatial as SP
from ..operators.arms import incident_ends, movement_cross, sector_arms
from ..operators.lanematch import boundary_widths, lane_samples, owner_candidates
from ..operators.topk import top_k
from .registry import query
from .views import VIEW_SQL

VIEW_SQL["patch_list"] = """SELECT road_id, string_agg(CAST(patch_id AS VARCHAR), ',' ORDER BY patch_id) AS patch_ids
    FROM (SELECT DISTINCT road_id, patch_id FROM patch_roads) GROUP BY road_id"""
VIEW_SQL["canon"] = "SELECT id AS node_id, coalesce(nullif(mainnodeid, 0), id) AS canonical_id FROM net_nodes"
VIEW_SQL["canon_roads"] = """SELECT r.*, coalesce(s.canonical_id, snodeid) AS src, coalesce(e.canonical_id, enodeid) AS dst FROM net_roads r
    LEFT JOIN canon s ON s.node_id = r.snodeid LEFT JOIN canon e ON e.node_id = r.enodeid"""
VIEW_SQL["relation_last"] = """SELECT target_id, max(base_id * 2 + status) // 2 AS base_id, CAST(max(base_id * 2 + status) % 2 AS INTEGER) AS status
    FROM relations GROUP BY target_id"""
# segments of two-point link roads as boxes do not bound the pairs, so the SQL side compares all of them
_D = """sqrt(pow({px} - x0 - greatest(0, least(1, (({px} - x0) * (x1 - x0) + ({py} - y0) * (y1 - y0)) / greatest(1e-9, pow(x1 - x0, 2) + pow(y1 - y0, 2)))) * (x1 - x0), 2)
    + pow({py} - y0 - greatest(0, least(1, (({px} - x0) * (x1 - x0) + ({py} - y0) * (y1 - y0)) / greatest(1e-9, pow(x1 - x0, 2) + pow(y1 - y0, 2)))) * (y1 - y0), 2))"""
VIEW_SQL["node_link_dist"] = f"""SELECT n.id AS p_id, l.id AS line_id, {_D.format(px='x', py='y')} AS dist FROM net_nodes n JOIN link_roads l
    ON x BETWEEN least(x0, x1) - 40 AND greatest(x0, x1) + 40 AND y BETWEEN least(y0, y1) - 40 AND greatest(y0, y1) + 40"""
VIEW_SQL["arm_ends"] = """SELECT junction_id, id, role, CASE WHEN a < 0 THEN a + 360 ELSE a END AS angle FROM (SELECT src AS junction_id, id,
    CASE WHEN direction < 2 THEN 'bidirectional' WHEN direction = 2 THEN 'outbound' ELSE 'inbound' END AS role,
    CASE WHEN abs(xs[4] - xs[1]) > 1e-9 OR abs(ys[4] - ys[1]) > 1e-9 THEN degrees(atan2(ys[4] - ys[1], xs[4] - xs[1])) END AS a
    FROM canon_roads WHERE src <> dst UNION ALL SELECT dst, id,
    CASE WHEN direction < 2 THEN 'bidirectional' WHEN direction = 3 THEN 'outbound' ELSE 'inbound' END,
    CASE WHEN abs(xs[4] - xs[1]) > 1e-9 OR abs(ys[4] - ys[1]) > 1e-9 THEN degrees(atan2(ys[1] - ys[4], xs[1] - xs[4])) END
    FROM canon_roads WHERE src <> dst)"""
VIEW_SQL["arms"] = """SELECT junction_id, CAST(floor(angle / 15) AS INTEGER) AS sector, count(*) AS roads,
    CAST(count_if(role IN ('inbound', 'bidirectional')) AS BIGINT) AS roads_in,
    CAST(count_if(role IN ('outbound', 'bidirectional')) AS BIGINT) AS roads_out, min(id) AS first_road_id
    FROM arm_ends WHERE angle IS NOT NULL GROUP BY ALL"""


def canon_roads(v):
    return J.with_canonical_ends(v.net_roads, J.canonical_nodes(v.net_nodes))


def arms(v, roads=None):
    return sector_arms(incident_ends(canon_roads(v) if roads is None else roads))


def relation_last(v):
    return J.relation_map(v.relations, F.col("base_id") * 2 + F.col("status"))


def node_points(v):
    return v.net_nodes.select(F.col("id").alias("p_id"), "x", "y")


def link_lines(v):
    return v.link_roads.select(F.col("id").alias("line_id"), "pts", "direction")


@query("patch_join", "SELECT id, patch_ids FROM net_roads r JOIN patch_list p ON p.road_id = r.id")
def _(v):
    return J.patch_join(v.net_roads.select("id"), v.patch_roads).where(F.col("reason").isNull()).select("id", "patch_ids")


@query("unmatched_reason", "SELECT id, 'no patch road match' AS reason FROM net_roads r WHERE id NOT IN (SELECT road_id FROM patch_roads)")
def _(v):
    return J.patch_join(v.net_roads.select("id"), v.patch_roads).where(F.col("reason").isNotNull()).select("id", "reason")


@query("kind_enrich")
def _(v):
    from ..plans.preprocess import kind_enrich
    return kind_enrich(v.spread(v.link_roads).select("id", "pts"), v.spread(v.net_roads).select(F.col("id").alias("line_id"), "pts", "kind"), 5.0, 5.0)


@query("restriction_pair_join", """SELECT c.memo, c.in_link, c.out_link, i.x0 AS in_x, o.x0 AS out_x FROM conditions c LEFT JOIN link_roads i
    ON i.id = c.in_link LEFT JOIN link_roads o ON o.id = c.out_link WHERE cond_type = 1""")
def _(v):
    pairs = J.restriction_pairs(v.conditions, v.link_roads)
    return pairs.select("memo", "in_link", "out_link", F.col("in_pts")[0]["x"].alias("in_x"), F.col("out_pts")[0]["x"].alias("out_x"))


@query("lane_road_join", """SELECT link, lane_dir, count(*) AS lanes, min(seq) AS first_seq, max(seq) AS last_seq FROM lanes l JOIN link_roads r
    ON r.id = l.link GROUP BY link, lane_dir""")
def _(v):
    from ..plans.preprocess import lane_groups
    return lane_groups(v.lanes, v.link_roads).select("link", "lane_dir", "lanes", "first_seq", "last_seq")


@query("node_alias_join", "SELECT id, src, dst, snodeid <> src OR enodeid <> dst AS moved FROM canon_roads")
def _(v):
    moved = (F.col("snodeid") != F.col("src")) | (F.col("enodeid") != F.col("dst"))
    return canon_roads(v).select("id", "src", "dst", moved.alias("moved"))


@query("semi_keep_roads", """SELECT id FROM net_roads WHERE snodeid IN (SELECT id FROM net_nodes WHERE kind_2 <> 1) AND enodeid IN
    (SELECT id FROM net_nodes WHERE kind_2 <> 1)""")
def _(v):
    kept = v.net_nodes.where(F.col("kind_2") != 1).select(F.col("id").alias("node_id"))
    return J.keep_roads_with_both_ends(v.net_roads, kept).select("id")


@query("anti_missing_endpoints", "SELECT id, 'end' AS \"end\", enodeid AS node_id FROM net_roads WHERE enodeid NOT IN (SELECT id FROM net_nodes)")
def _(v):
    return J.missing_ends(v.net_roads, v.net_nodes.select(F.col("id").alias("node_id"))).select("id", "end", "node_id")


@query("point_surface_join", """SELECT n.id AS p_id, s.surface_id AS ring_id FROM net_nodes n JOIN surfaces s ON x BETWEEN x0 - 1.5 AND x1 + 1.5
    AND y BETWEEN y0 - 1.5 AND y1 + 1.5 WHERE sqrt(pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2)) <= 1.5""")
def _(v):
    return SP.points_in_rings(node_points(v), v.surfaces.select(F.col("surface_id").alias("ring_id"), "ring"), 40.0, 1.5)


@query("distance_join", """SELECT n.id AS l_id, l.id AS r_id, round(sqrt(pow(n.x - l.x0, 2) + pow(n.y - l.y0, 2)), 4) AS dist FROM net_nodes n
    JOIN link_roads l ON abs(n.x - l.x0) <= 20 AND abs(n.y - l.y0) <= 20 WHERE sqrt(pow(n.x - l.x0, 2) + pow(n.y - l.y0, 2)) <= 20""")
def _(v):
    left = v.net_nodes.select(F.col("id").alias("l_id"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    right = v.link_roads.select(F.col("id").alias("r_id"), F.col("pts")[0]["x"].alias("rx"), F.col("pts")[0]["y"].alias("ry"))
    return SP.distance_join(left, right, 20.0).select("l_id", "r_id", F.round("dist", 4).alias("dist"))


@query("nearest_join", """SELECT p_id, line_id, round(dist, 4) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY p_id ORDER BY dist, line_id) AS rn
    FROM node_link_dist WHERE dist <= 40) WHERE rn = 1""")
def _(v):
    return SP.nearest_line(node_points(v), v.spread(link_lines(v), "line_id"), 40.0).select("p_id", "line_id", F.round("dist", 4).alias("dist"))


@query("lane_owner_candidates")
def _(v):
    lanes = v.link_roads.where(F.col("id") % 3 != 0).select(F.col("id").alias("lane_id"), "pts")
    roads = link_lines(v).where(F.col("line_id") % 3 == 0)
    found = owner_candidates(lane_samples(lanes, 5.0), roads, 30.0)
    return found.select("lane_id", "line_id", "samples", F.round("owner_score", 4).alias("owner_score"))


@query("boundary_pair_width")
def _(v):
    lanes = v.link_roads.select(F.col("id").alias("lane_id"), "pts")
    shifted = F.transform(F.col("pts"), lambda p: F.struct(p["x"].alias("x"), (p["y"] + F.col("id") % 5 + 1).alias("y")))
    other = F.transform(F.col("pts"), lambda p: F.struct(p["x"].alias("x"), (p["y"] - F.col("id") % 3 - 1).alias("y")))
    bounds = v.link_roads.select((F.col("id") * 2).alias("line_id"), shifted.alias("pts")).unionAll(
        v.link_roads.select((F.col("id") * 2 + 1).alias("line_id"), other.alias("pts")))
    widths = boundary_widths(lane_samples(lanes, 5.0), bounds, 6.0, 20.0)
    return widths.select("lane_id", "both_samples", F.round("width_median", 4).alias("width_median"))


@query("relation_lookup", """WITH c AS (SELECT s.*, r.base_id, CASE WHEN r.target_id IS NULL THEN 'missing_' || role || '_relation'
    WHEN r.status <> 0 THEN 'invalid_' || role || '_relation_status' WHEN r.base_id <= 0 THEN 'invalid_' || role || '_base_id' END AS reason
    FROM seg_nodes s LEFT JOIN relation_last r ON r.target_id = s.node_id)
    SELECT segment_id, count(reason) = 0 AS passed, arg_min(reason, pos) FILTER (WHERE reason IS NOT NULL) AS reason, count(reason) AS failed_nodes,
    coalesce(string_agg(CASE WHEN reason IS NULL THEN CAST(base_id AS VARCHAR) END, ',' ORDER BY pos), '') AS base_ids FROM c GROUP BY segment_id""")
def _(v):
    return J.relation_lookup(v.seg_nodes, relation_last(v))


@query("source_fullmatch_join", """SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_current' WHEN a.id IS NULL THEN 'only_baseline'
    WHEN a.direction = b.direction THEN 'same' ELSE 'changed' END AS status FROM (SELECT id, direction FROM net_roads WHERE id % 6 <> 0) a
    FULL JOIN (SELECT id, CASE WHEN id % 4 = 0 THEN 9 ELSE direction END AS direction FROM net_roads WHERE id % 5 <> 0) b ON a.id = b.id""")
def _(v):
    current = v.net_roads.where(F.col("id") % 6 != 0)
    baseline = v.net_roads.where(F.col("id") % 5 != 0).withColumn("direction", F.when(F.col("id") % 4 == 0, 9).otherwise(F.col("direction")))
    return J.compare_versions(current, baseline, ["id"], ["direction"])


@query("movement_cross", """SELECT a.junction_id, a.sector AS from_sector, a.roads_in, b.sector AS to_sector, b.roads_out FROM arms a JOIN arms b
    ON a.junction_id = b.junction_id WHERE a.roads_in > 0 AND b.roads_out > 0""")
def _(v):
    return movement_cross(arms(v))


@query("candidate_pair_cross", """WITH d AS (SELECT DISTINCT junction_id, id % 3 AS dataset, CAST(floor(angle / 15) AS INTEGER) AS sector FROM arm_ends
    WHERE angle IS NOT NULL) SELECT a.junction_id, a.dataset AS left_set, b.dataset AS right_set, a.sector AS left_sector, b.sector AS right_sector
    FROM d a JOIN d b ON a.junction_id = b.junction_id AND a.dataset < b.dataset""")
def _(v):
    from ..plans.arms import dataset_arm_pairs
    ends = incident_ends(canon_roads(v)).withColumn("dataset", F.col("id") % 3)
    return dataset_arm_pairs(ends)


@query("id_collision", "SELECT r.id, r.direction AS left_direction, l.direction AS right_direction FROM net_roads r JOIN link_roads l ON l.id = r.id")
def _(v):
    return v.net_roads.select("id", F.col("direction").alias("left_direction")).join(
        v.link_roads.select("id", F.col("direction").alias("right_direction")), "id")


@query("rcsd_context_50m", """WITH p AS (SELECT n.id, l.id AS r_id, sqrt(pow(n.x - l.x0, 2) + pow(n.y - l.y0, 2)) AS d FROM net_nodes n JOIN link_roads l
    ON abs(n.x - l.x0) <= 50 AND abs(n.y - l.y0) <= 50 WHERE sqrt(pow(n.x - l.x0, 2) + pow(n.y - l.y0, 2)) <= 50),
    t AS (SELECT id, r_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, r_id) AS rn FROM p) WHERE rn <= 5)
    SELECT n.id, coalesce(any_value(c.n), 0) AS feature_count, any_value(round(c.d, 3)) AS nearest_m, coalesce(string_agg(CAST(t.r_id AS VARCHAR), ',' ORDER BY t.r_id), '')
    AS nearest_ids FROM net_nodes n LEFT JOIN (SELECT id, count(*) AS n, min(d) AS d FROM p GROUP BY id) c ON c.id = n.id LEFT JOIN t ON t.id = n.id GROUP BY n.id""")
def _(v):
    from ..plans.review import carrier_context
    nodes = v.net_nodes.select("id", "x", "y")
    carriers = v.link_roads.select(F.col("id").alias("feature_id"), F.col("pts")[0]["x"].alias("fx"), F.col("pts")[0]["y"].alias("fy"))
    return carrier_context(nodes, carriers, 50.0, 5)


@query("restriction_geometry_match", f"""WITH d AS (SELECT r.id AS restriction_id, l.id AS road_id, {_D.format(px='r.xs[1]', py='r.ys[1]')} AS dist,
    degrees(atan2(r.ys[2] - r.ys[1], r.xs[2] - r.xs[1])) - degrees(atan2(y1 - y0, x1 - x0)) AS da FROM net_roads r JOIN link_roads l
    ON r.xs[1] BETWEEN least(x0, x1) - 12 AND greatest(x0, x1) + 12 AND r.ys[1] BETWEEN least(y0, y1) - 12 AND greatest(y0, y1) + 12
    WHERE (r.xs[2] <> r.xs[1] OR r.ys[2] <> r.ys[1]) AND (x1 <> x0 OR y1 <> y0)),
    m AS (SELECT *, least(abs(da) % 360, 360 - abs(da) % 360) AS delta FROM d)
    SELECT restriction_id, road_id, round(dist, 3) AS dist, round(delta, 3) AS delta, round(least(0.95, 0.55 + 0.25 * greatest(0, 1 - dist / 12)
    + 0.20 * greatest(0, 1 - delta / 35)), 4) AS confidence FROM m WHERE dist <= 12 AND delta <= 35""")
def _(v):
    from ..plans.rules import match_restrictions
    restrictions = v.net_roads.select(F.col("id").alias("restriction_id"), "pts")
    return match_restrictions(restrictions, v.link_roads.select(F.col("id").alias("road_id"), "pts")).select(
        "restriction_id", "road_id", F.round("dist", 3).alias("dist"), F.round("delta", 3).alias("delta"),
        F.round("confidence", 4).alias("confidence"))


@query("station_range_join", """SELECT road_id, range_id, count(*) AS stations, CAST(sum(s) AS BIGINT) AS sum_s FROM
    (SELECT l_orderkey AS road_id, l_partkey % 500 AS s FROM lineitem) JOIN (SELECT o_orderkey AS road_id, o_orderkey + 1 AS range_id,
    o_custkey % 300 AS start_m, o_custkey % 300 + 120 AS end_m FROM orders) USING (road_id) WHERE s BETWEEN start_m AND end_m GROUP BY ALL""")
def _(v):
    stations = v.lineitem.select(F.col("l_orderkey").alias("road_id"), (F.col("l_partkey") % 500).alias("s"))
    start = F.col("o_custkey") % 300
    ranges = v.orders.select(F.col("o_orderkey").alias("road_id"), (F.col("o_orderkey") + 1).alias("range_id"),
                             start.alias("start_m"), (start + 120).alias("end_m"))
    joined = J.station_range_join(stations, ranges, 100.0)
    return joined.groupBy("road_id", "range_id").agg(F.count("*").alias("stations"), F.sum("s").alias("sum_s"))
