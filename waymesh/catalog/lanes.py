"""Lane evidence and built roads."""
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators.arms import incident_ends
from ..operators.lanematch import lane_samples
from ..plans import lanes as L
from .geometry import chord
from .joins import canon_roads
from .registry import query
from .replacement import with_carrier


@query("lane_assign_decision", """WITH o AS (SELECT doc_id AS lane_id, n_chars % 40 AS p90, doc_id * 7 % 60 AS delta, CASE WHEN doc_id % 9 > 0 THEN doc_id * 3 % 20 END AS margin, doc_id % 10 / 10.0 AS bilateral, CASE WHEN doc_id % 13 > 0 THEN doc_id % 70 / 10.0 END AS width, doc_id % 50 / 10.0 AS var, doc_id % 11 / 10.0 AS zone FROM documents),
    s AS (SELECT *, CASE WHEN p90 > 30 OR delta > 50 THEN 'insufficient_evidence' WHEN p90 > 20 OR delta > 35 OR margin IS NULL OR margin < 5 THEN 'review_required' ELSE 'accepted' END AS owner_state, CASE WHEN width IS NULL OR bilateral < 0.5 THEN 'insufficient_evidence' WHEN bilateral < 0.75 THEN 'partial'
    WHEN width < 2.5 THEN 'narrow_candidate' WHEN width > 5 THEN 'wide_or_boundary_gap' WHEN var > 2.5 THEN 'unstable' ELSE 'nominal' END AS width_state FROM o) SELECT lane_id, owner_state, width_state, CASE WHEN owner_state = 'insufficient_evidence' OR width_state = 'insufficient_evidence' THEN 'insufficient_evidence'
    WHEN owner_state = 'review_required' OR width_state <> 'nominal' OR zone < 0.8 THEN 'review_required' ELSE 'accepted' END AS decision FROM s""")
def _(v):
    d = F.col("doc_id")
    rows = v.documents.select(d.alias("lane_id"), (F.col("n_chars") % 40).alias("p90"), (d * 7 % 60).alias("delta"), F.when(d % 9 > 0, d * 3 % 20).alias("margin"), (d % 10 / 10.0).alias("bilateral"), F.when(d % 13 > 0, d % 70 / 10.0).alias("width_median"),
                              (d % 50 / 10.0).alias("width_variation"), (d % 11 / 10.0).alias("zone_cover"))
    return L.lane_assign_decision(rows)


@query("map_match_viterbi")
def _(v):
    lanes = v.net_roads.select(F.col("id").alias("lane_id"), "pts")
    roads = v.link_roads.select(F.col("id").alias("line_id"), "pts", "direction", F.array("snodeid", "enodeid").alias("ends"))
    return L.match_lanes(lanes, roads, 10.0, 25.0)


@query("support_intervals", """WITH f AS (SELECT l_orderkey AS road_id, i, bool_or(l_returnflag = 'A') AS sup FROM (SELECT l_orderkey, l_linenumber AS i, l_returnflag FROM lineitem) GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY i) - row_number() OVER (PARTITION BY road_id, sup ORDER BY i) AS k FROM f)
    SELECT road_id, CASE WHEN sup THEN 'hp_supported' ELSE 'gap' END AS state, min(i) * 5.0 AS start_m, max(i) * 5.0 AS end_m FROM g GROUP BY road_id, sup, k""".replace("* 5.0 AS", "* 5.0::DOUBLE AS"))
def _(v):
    samples = v.lineitem.groupBy(F.col("l_orderkey").alias("road_id"), F.col("l_linenumber").alias("i")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("supported"))
    return L.support_intervals(samples, 5.0)


@query("station_fit", """WITH st AS (SELECT DISTINCT l_orderkey AS road_id, l_partkey % 300 AS s FROM lineitem), ln AS (SELECT l_orderkey AS road_id, l_suppkey AS a, l_suppkey + 90 AS b, l_suppkey % 13 AS v, l_linenumber AS w FROM lineitem),
    j AS (SELECT st.road_id, s, v, CAST(sum(w) AS BIGINT) AS w FROM st JOIN ln ON ln.road_id = st.road_id AND s BETWEEN a AND b GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY road_id, s ORDER BY v) AS u, sum(w) OVER (PARTITION BY road_id, s) / 2.0 AS h FROM j),
    m AS (SELECT road_id, s, (min(CASE WHEN u >= h THEN v END) + coalesce(min(CASE WHEN u > h THEN v END), min(CASE WHEN u >= h THEN v END))) / 2.0 AS shift FROM c GROUP BY ALL)
    SELECT road_id, s, coalesce(CAST(shift AS DOUBLE), 0.0::DOUBLE) AS shift, CASE WHEN shift IS NULL THEN 'swsd_gap' ELSE 'hp_lane_median' END AS source FROM st LEFT JOIN m USING (road_id, s)""")
def _(v):
    stations = v.lineitem.select(F.col("l_orderkey").alias("road_id"), (F.col("l_partkey") % 300).alias("s")).distinct()
    lanes = v.lineitem.select(F.col("l_orderkey").alias("road_id"), F.col("l_suppkey").alias("start_m"), (F.col("l_suppkey") + 90).alias("end_m"), F.lit(0).alias("range_id"), (F.col("l_suppkey") % 13).cast("double").alias("offset"), F.col("l_linenumber").alias("weight"))
    return L.station_fit(stations, lanes)


@query("lane_group_build", "SELECT snodeid AS road_id, direction, count(*) AS lanes, quantile_cont(id % 50, 0.5) AS width_median, min(id) AS first_lane FROM net_roads GROUP BY ALL")
def _(v):
    return L.lane_groups(v.net_roads.select(F.col("id").alias("lane_id"), F.col("snodeid").alias("road_id"), "direction", (F.col("id") % 50).cast("double").alias("width")))


@query("lane_topo_to_roads", """WITH lk AS (SELECT DISTINCT l_orderkey AS f, l_partkey AS t FROM lineitem), ow AS (SELECT o_orderkey AS lane_id, o_custkey AS road_id FROM orders WHERE o_orderkey % 10 <> 0), rp AS (SELECT DISTINCT snodeid - 1 AS a, (enodeid - 1) AS b FROM net_roads),
    c1 AS (SELECT a, b FROM rp WHERE b IN (SELECT c_custkey FROM customer WHERE c_nationkey = 0)), c2 AS (SELECT DISTINCT c.a, d.b FROM c1 c JOIN c1 d ON d.a = c.b), c3 AS (SELECT DISTINCT c.a, d.b FROM c2 c JOIN c1 d ON d.a = c.b),
    cp AS (SELECT DISTINCT c.a, d.b FROM (SELECT * FROM c1 UNION SELECT * FROM c2 UNION SELECT * FROM c3) c JOIN rp d ON d.a = c.b)
    SELECT f AS from_lane, t AS to_lane, CASE WHEN x.road_id IS NULL OR y.road_id IS NULL THEN 'lane_without_road' WHEN x.road_id = y.road_id THEN 'same_road' WHEN p.a IS NOT NULL THEN 'direct' WHEN q.a IS NOT NULL THEN 'by_lineage' WHEN r.a IS NOT NULL THEN 'via_junction_carrier' ELSE 'unsupported' END AS state
    FROM lk LEFT JOIN ow x ON x.lane_id = f LEFT JOIN ow y ON y.lane_id = t LEFT JOIN rp p ON p.a = x.road_id AND p.b = y.road_id LEFT JOIN rp q ON q.a = x.road_id // 2 AND q.b = y.road_id // 2 LEFT JOIN cp r ON r.a = x.road_id AND r.b = y.road_id""")
def _(v):
    links = v.lineitem.select(F.col("l_orderkey").alias("from_lane"), F.col("l_partkey").alias("to_lane")).distinct()
    owner = v.orders.where("o_orderkey % 10 != 0").select(F.col("o_orderkey").alias("lane_id"), F.col("o_custkey").alias("road_id"))
    pairs = v.net_roads.select((F.col("snodeid") - 1).alias("from_road"), (F.col("enodeid") - 1).alias("to_road"))
    lineage = v.customer.select(F.col("c_custkey").alias("road_id"), F.floor(F.col("c_custkey") / 2).alias("parent_id"))
    carriers = v.customer.where("c_nationkey = 0").select(F.col("c_custkey").alias("road_id"))
    return L.lane_links_on_roads(links, owner, pairs, lineage, carriers)


@query("movement_support_rank", """SELECT from_road, to_road, links, CAST(rn AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY from_road ORDER BY links DESC, to_road) AS rn FROM (SELECT l_partkey AS from_road, l_suppkey AS to_road, count(*) AS links FROM lineitem GROUP BY ALL)) WHERE rn <= 3""")
def _(v):
    return L.movement_support_rank(v.lineitem.select(F.col("l_partkey").alias("from_road"), F.col("l_suppkey").alias("to_road")))


@query("road_lane_relation", """WITH r AS (SELECT o_orderkey AS road_id, o_custkey % 50 AS a, o_custkey % 50 + 100 AS b FROM orders), l AS (SELECT l_orderkey AS road_id, l_suppkey AS lane_id, l_partkey % 120 AS c, l_partkey % 120 + 30 AS d FROM lineitem)
    SELECT road_id, lane_id, round(least(1.0, sum(least(b, d) - greatest(a, c)) / 100.0::DOUBLE), 6) AS share FROM l JOIN r USING (road_id) WHERE least(b, d) > greatest(a, c) GROUP BY ALL""")
def _(v):
    roads = v.orders.select(F.col("o_orderkey").alias("road_id"), (F.col("o_custkey") % 50).alias("start_m"), (F.col("o_custkey") % 50 + 100).alias("end_m"))
    lanes = v.lineitem.select(F.col("l_orderkey").alias("road_id"), F.col("l_suppkey").alias("lane_id"), (F.col("l_partkey") % 120).alias("lane_start"), (F.col("l_partkey") % 120 + 30).alias("lane_end"))
    return L.road_lane_relation(roads, lanes)


@query("parallel_pair_audit", """WITH r AS (SELECT o_custkey AS p, CASE WHEN o_orderkey % 3 > 0 THEN 'forward' ELSE 'backward' END AS side, CASE WHEN o_orderkey % 5 < 2 THEN 'published' ELSE 'supported' END AS st, o_orderkey % 17 AS off FROM orders)
    SELECT p AS parent_id, CASE WHEN bool_or(side = 'forward' AND st = 'published') AND bool_or(side = 'backward' AND st = 'published') THEN 'both_published' WHEN bool_or(side = 'forward') AND bool_or(side = 'backward') THEN 'both_supported' ELSE 'single_side' END AS state,
    coalesce(max(CASE WHEN side = 'forward' THEN off END) > min(CASE WHEN side = 'backward' THEN off END), false) AS crossing FROM r GROUP BY p""")
def _(v):
    o = F.col("o_orderkey")
    return L.parallel_pairs(v.orders.select(F.col("o_custkey").alias("parent_id"), F.when(o % 3 > 0, "forward").otherwise("backward").alias("side"), F.when(o % 5 < 2, "published").otherwise("supported").alias("state"), (o % 17).alias("offset")))


@query("smoothness_audit", "SELECT id, round(greatest(t1, t2), 4) AS max_turn_deg, CAST(coalesce(round(t1, 9) > 45, false) AS BIGINT) + CAST(coalesce(round(t2, 9) > 45, false) AS BIGINT) AS sharp_vertices FROM road_turns")
def _(v):
    return L.smoothness(v.net_roads.select("id", "pts"), 45.0)


@query("publish_state", """SELECT o_orderkey AS road_id, CASE WHEN o_orderkey % 11 = 0 THEN 'conflict_retained' WHEN o_orderkey % 7 = 0 THEN 'retained' WHEN o_orderkey % 100 >= 95 AND o_custkey % 20 <= 10 THEN 'full' ELSE 'partial' END AS state FROM orders""")
def _(v):
    o = F.col("o_orderkey")
    return L.publish_state(v.orders.select(o.alias("road_id"), (o % 11 == 0).alias("conflict"), (o % 7 != 0).alias("supported"), (o % 100 / 100.0).alias("coverage"), (F.col("o_custkey") % 20).alias("max_gap_m")))


@query("retained_overlap", """SELECT id AS road_id, round(count_if(d <= 2) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM chord_distances WHERE id IN (SELECT segment_id FROM lookup WHERE reason IS NOT NULL) GROUP BY id HAVING round(count_if(d <= 2) / CAST(count(*) AS DOUBLE), 6) >= 0.65""")
def _(v):
    from .replacement import lookup
    ratio = with_carrier(v).select(F.col("id").alias("road_id"), F.round(G.coverage_ratio(F.col("pts"), F.col("carrier"), 2.0, 10.0), 6).alias("ratio"))
    return L.retained_overlap(ratio, lookup(v).select(F.col("segment_id").alias("road_id"), (~F.col("passed")).alias("reaches_both")))


@query("lineage_split")
def _(v):
    cuts = v.net_roads.select(F.col("id").alias("road_id"), (F.col("id") % 40 + 5).cast("double").alias("measure")).unionAll(
        v.net_roads.select(F.col("id").alias("road_id"), (F.col("id") % 23 + 20).cast("double").alias("measure")))
    rows = L.lineage_split(v.net_roads.select(F.col("id").alias("road_id"), "pts"), cuts)
    return rows.select("parent_id", "child_no", F.round("start_m", 4).alias("start_m"), F.round("end_m", 4).alias("end_m"))


@query("swsd_access_audit", """WITH a AS (SELECT DISTINCT junction_id, role FROM arm_ends WHERE id % 2 = 0), b AS (SELECT DISTINCT junction_id, role FROM arm_ends WHERE id % 3 = 0) SELECT coalesce(a.junction_id, b.junction_id) AS junction_id, coalesce(a.role, b.role) AS role,
    CASE WHEN a.role IS NULL THEN 'extra' WHEN b.role IS NULL THEN 'missing' ELSE 'ok' END AS state FROM a FULL JOIN b ON a.junction_id = b.junction_id AND a.role = b.role""")
def _(v):
    ends = incident_ends(canon_roads(v))
    return L.access_audit(ends.where("id % 2 = 0"), ends.where("id % 3 = 0"))
