"""Junction arms, movements and turn rules."""
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.angles import bundle_arms
from ..operators.arms import incident_ends
from ..operators.graph import directed_edges, shortest_distances, trace_back
from ..plans import arms as AR
from ..plans import rules as RU
from .graphs import chain_edges, end_pairs
from .joins import arms, canon_roads
from .registry import query
from .views import VIEW_SQL

VIEW_SQL["movements"] = """SELECT l_orderkey * 10 + l_linenumber AS movement_id, l_partkey AS from_road, l_suppkey AS to_road, ['straight', 'left', 'right', 'uturn'][CAST(l_linenumber % 4 + 1 AS INTEGER)] AS movement_type, l_returnflag <> 'R' AS applicable FROM lineitem"""


def movements(v):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("straight", "left", "right", "uturn")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return v.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("movement_id"), F.col("l_partkey").alias("from_road"), F.col("l_suppkey").alias("to_road"), kind.alias("movement_type"),
                             (F.col("l_returnflag") != "R").alias("applicable"))


def dataset_ends(v):
    return incident_ends(canon_roads(v)).withColumn("dataset", F.col("id") % 3)


@query("arms_build")
def _(v):
    return bundle_arms(incident_ends(canon_roads(v))).where("arm_role != 'none'")


@query("movements_build", """WITH p AS (SELECT a.junction_id, a.sector AS from_sector, b.sector AS to_sector, a.roads_in * b.roads_out AS road_pairs, radians((b.sector - a.sector) * 15.0 + 180) AS d FROM arms a JOIN arms b ON a.junction_id = b.junction_id
    WHERE a.roads_in > 0 AND b.roads_out > 0) SELECT junction_id, from_sector, to_sector, road_pairs, CASE WHEN from_sector = to_sector THEN 'uturn' WHEN round(degrees(acos(greatest(-1, least(1, cos(d))))), 6) <= 35 THEN 'straight' WHEN abs(sin(d)) <= 0.08 THEN 'unknown'
    WHEN sin(d) > 0 THEN 'left' ELSE 'right' END AS movement_type FROM p""")
def _(v):
    return RU.build_movements(incident_ends(canon_roads(v)))


@query("arrow_exclusion")
def _(v):
    m = movements(v).select("movement_id", F.col("from_road").alias("road_id"), "movement_type")
    arrows = v.part.select(F.col("p_partkey").alias("road_id"), F.concat_ws(",", F.substring(F.lit("abcefghijk"), (F.col("p_partkey") % 10 + 1).cast("int"), F.lit(1)), F.substring(F.lit("9aBdq"), (F.col("p_partkey") % 5 + 1).cast("int"), F.lit(1))).alias("codes"),
                           (F.col("p_size") % 7 != 0).alias("direction_matched"), (F.col("p_size") % 5 != 0).alias("sequence_complete"))
    return RU.arrow_exclusion(m, arrows)


@query("special_carrier", """WITH p AS (SELECT snodeid AS junction_id, id % 4 AS arm_id, count_if(formway & 256 <> 0) AS l, count_if(formway & 128 <> 0) AS r, count_if(formway & 384 = 0) AS c FROM net_roads GROUP BY ALL) SELECT junction_id, arm_id, CAST(l AS BIGINT) AS left_roads,
    CAST(r AS BIGINT) AS right_roads, CAST(c AS BIGINT) AS core_roads, CASE WHEN l > 0 THEN 'default_support' WHEN l + r > 0 THEN 'weak_limit' ELSE 'none' END AS left, CASE WHEN r > 0 THEN 'default_support' WHEN l + r > 0 THEN 'weak_limit' ELSE 'none' END AS right,
    NULL::VARCHAR AS risk FROM p""".replace("AS left,", 'AS "left",').replace("AS right,", 'AS "right",'))
def _(v):
    return RU.special_carrier(v.net_roads.select(F.col("snodeid").alias("junction_id"), (F.col("id") % 4).alias("arm_id"), F.col("id").alias("road_id"), "formway", "kind"))


@query("restriction_scope", """WITH p AS (SELECT DISTINCT movement_id // 40 AS movement_id, from_road, to_road FROM movements), r AS (SELECT DISTINCT l_linenumber % 3 AS condition_id, l_partkey AS from_road, l_suppkey AS to_road FROM lineitem WHERE l_returnflag = 'A'),
    t AS (SELECT movement_id, count(*) AS total FROM p GROUP BY 1) SELECT movement_id, condition_id, covered, total, CASE WHEN covered = total THEN 'arm_to_arm' ELSE 'road_pair' END AS scope FROM (SELECT movement_id, condition_id, count(*) AS covered
    FROM p JOIN r USING (from_road, to_road) GROUP BY ALL) JOIN t USING (movement_id)""")
def _(v):
    pairs = movements(v).select(F.floor(F.col("movement_id") / 40).alias("movement_id"), "from_road", "to_road")
    restrictions = v.lineitem.where("l_returnflag = 'A'").select((F.col("l_linenumber") % 3).alias("condition_id"), F.col("l_partkey").alias("from_road"), F.col("l_suppkey").alias("to_road"))
    return RU.restriction_scope(pairs, restrictions)


@query("rule_decision", """WITH e AS (SELECT l_orderkey AS movement_id, l_partkey AS road_id, ['restriction', 'laneinfo', 'special_carrier'][CAST(l_linenumber % 3 + 1 AS INTEGER)] AS source, ['prohibited', 'supported', 'unknown'][CAST(l_suppkey % 3 + 1 AS INTEGER)] AS decision FROM lineitem),
    k AS (SELECT movement_id, road_id, source, min(decision) AS decision, list_position(['restriction', 'laneinfo', 'special_carrier'], source) AS r FROM e WHERE decision <> 'unknown' GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY movement_id, road_id ORDER BY r) AS rn FROM k)
    SELECT v.movement_id, v.road_id, coalesce(max(CASE WHEN rn = 1 THEN decision END), 'unknown') AS decision, max(CASE WHEN rn = 1 THEN source END) AS source, coalesce(string_agg(CASE WHEN rn > 1 THEN source || ':' || decision END, ',' ORDER BY rn), '') AS overrides
    FROM (SELECT DISTINCT movement_id, road_id FROM e) v LEFT JOIN n USING (movement_id, road_id) GROUP BY ALL""")
def _(v):
    source = F.element_at(F.array(*[F.lit(x) for x in RU.EVIDENCE_ORDER]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    decision = F.element_at(F.array(*[F.lit(x) for x in ("prohibited", "supported", "unknown")]), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return RU.decide_rules(v.lineitem.select(F.col("l_orderkey").alias("movement_id"), F.col("l_partkey").alias("road_id"), source.alias("source"), decision.alias("decision")))


@query("rule_projection", """WITH m AS (SELECT target_id AS road_id, count(DISTINCT base_id) AS n, min(base_id) AS f FROM relations WHERE status = 0 GROUP BY 1) SELECT movement_id AS rule_id, a.f AS final_from, b.f AS final_to, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 'unmapped'
    WHEN a.n = 1 AND b.n = 1 THEN 'stable' ELSE 'candidate' END AS state FROM movements LEFT JOIN m a ON a.road_id = from_road LEFT JOIN m b ON b.road_id = to_road""")
def _(v):
    segment_map = v.relations.where("status = 0").select(F.col("target_id").alias("road_id"), F.col("base_id").alias("final_road"))
    return RU.project_rules(movements(v).select(F.col("movement_id").alias("rule_id"), "from_road", "to_road"), segment_map)


_V1 = """v1 AS (SELECT m.movement_id // 10 AS movement_id, bool_and(applicable) AS ok, count(*) AS pairs, count(r.from_road) AS restricted_pairs FROM movements m LEFT JOIN (SELECT DISTINCT l_partkey AS from_road, l_suppkey AS to_road FROM lineitem WHERE l_linenumber = 2) r
    ON r.from_road = m.from_road AND r.to_road = m.to_road GROUP BY 1), rules AS (SELECT movement_id, pairs, restricted_pairs, CASE WHEN NOT ok THEN 'not_a_traffic_rule' WHEN restricted_pairs = 0 THEN 'no_prohibition_evidence' WHEN restricted_pairs = pairs
    THEN 'prohibited' ELSE 'partially_prohibited' END AS status FROM v1)"""


def rules_v1(v):
    m = movements(v).withColumn("movement_id", F.floor(F.col("movement_id") / 10))
    restrictions = v.lineitem.where("l_linenumber = 2").select(F.col("l_partkey").alias("from_road"), F.col("l_suppkey").alias("to_road"))
    return RU.restore_rules_v1(m, restrictions)


@query("rule_v1_restore", f"WITH {_V1} SELECT * FROM rules")
def _(v):
    return rules_v1(v)


@query("rule_counts", f"WITH {_V1} SELECT status, count(*) AS n, CAST(sum(restricted_pairs) AS BIGINT) AS restricted_pairs FROM rules GROUP BY 1")
def _(v):
    return rules_v1(v).groupBy("status").agg(F.count("*").alias("n"), F.sum("restricted_pairs").alias("restricted_pairs"))


VIEW_SQL["arm_profiles"] = """SELECT junction_id, id % 3 AS dataset, CAST(floor(angle / 30) AS INTEGER) AS arm, count(*) AS roads, bool_or(role <> 'outbound') AS has_in, bool_or(role <> 'inbound') AS has_out, avg(sin(radians(angle))) AS s, avg(cos(radians(angle))) AS c
    FROM arm_ends WHERE angle IS NOT NULL GROUP BY ALL"""


def profile_scores(v):
    return AR.arm_scores(AR.arm_profiles(dataset_ends(v)), 0, 1)


@query("arm_alignment_score", """WITH p AS (SELECT *, degrees(atan2(s, c)) AS t, CASE WHEN has_in AND has_out THEN 'b' WHEN has_in THEN 'i' ELSE 'o' END AS r FROM arm_profiles), q AS (SELECT a.junction_id, a.arm AS left_arm, b.arm AS right_arm, a.r AS lr, b.r AS rr,
    round(least(abs(a.t - b.t), 360 - abs(a.t - b.t)), 6) AS d, least(a.roads, b.roads) / CAST(greatest(a.roads, b.roads) AS DOUBLE) AS k FROM p a JOIN p b ON a.junction_id = b.junction_id WHERE a.dataset = 0 AND b.dataset = 1)
    SELECT junction_id, left_arm, right_arm, round(CASE WHEN lr = rr THEN 25.0 WHEN lr = 'b' OR rr = 'b' THEN 22.0 ELSE 18.0 END + CASE WHEN d <= 20 THEN 25.0 WHEN d <= 45 THEN 18.0 WHEN d <= 90 THEN 10.0 ELSE 4.0 END + 10.0 + CASE WHEN k >= 0.65 THEN 20.0 WHEN k >= 0.35 THEN 14.0 ELSE 8.0 END
    + round(15.0 * (1 - least(d, 90.0) / 90.0), 2), 2) AS score FROM q""")
def _(v):
    return profile_scores(v).select("junction_id", "left_arm", "right_arm", F.round("score", 2).alias("score"))


@query("arm_assignment")
def _(v):
    return AR.assign_arms(profile_scores(v))


@query("logical_arm_groups")
def _(v):
    return AR.logical_groups(AR.arm_profiles(dataset_ends(v)), profile_scores(v))


@query("road_next_road_generate", """WITH m AS (SELECT DISTINCT target_id AS road_id, base_id AS target_road, ['approach', 'exit', 'both'][CAST(target_id % 3 + 1 AS INTEGER)] AS role FROM relation_last WHERE status = 0) SELECT DISTINCT a.target_road AS target_from, b.target_road AS target_to
    FROM (SELECT DISTINCT from_road, to_road FROM movements) p JOIN m a ON a.road_id = from_road AND a.role <> 'exit' JOIN m b ON b.road_id = to_road AND b.role <> 'approach' WHERE a.target_road <> b.target_road""")
def _(v):
    from .joins import relation_last
    role = F.element_at(F.array(F.lit("approach"), F.lit("exit"), F.lit("both")), (F.col("target_id") % 3 + 1).cast("int"))
    mapping = relation_last(v).where("status = 0").select(F.col("target_id").alias("road_id"), F.col("base_id").alias("target_road"), role.alias("role"))
    return AR.generate_road_next_road(movements(v).select("from_road", "to_road"), mapping)


@query("trunk_path", """WITH pairs AS (SELECT (id - 1) // 8 AS unit, id AS a, id + 5 AS b FROM net_nodes WHERE id % 8 = 1 AND id + 5 <= (SELECT count(*) FROM customer)), r(unit, b, node, d, n, seen) AS (SELECT unit, b, a, 0::BIGINT, 0, [a] FROM pairs UNION ALL SELECT r.unit, r.b, e.dst, r.d + e.length_m, n + 1,
    list_append(seen, e.dst) FROM r JOIN chain_directed e ON e.src = r.node AND e.unit = r.unit WHERE NOT list_contains(seen, e.dst)) SELECT unit, CAST(min(d) AS DOUBLE) AS length_m, arg_min(n, d)::BIGINT AS roads FROM r WHERE node = b GROUP BY unit""")
def _(v):
    edges = directed_edges(chain_edges(v))
    ends = end_pairs(v)
    best = shortest_distances(edges, ends.select("unit", F.col("a").alias("node")))
    targets = ends.select("unit", F.col("b").alias("node"))
    path = trace_back(best, edges, targets).groupBy("unit").agg(F.count("*").alias("roads"))
    return best.join(targets, ["unit", "node"]).join(path, "unit").select("unit", F.col("dist_m").alias("length_m"), "roads")


@query("advance_right_relations")
def _(v):
    return AR.advance_right_relations(v.net_roads, incident_ends(canon_roads(v)))


@query("movement_evidence", """WITH p AS (SELECT a.junction_id, a.sector AS f, b.sector AS t, abs((b.sector - a.sector) * 15.0 - 180) % 360 AS d FROM arms a JOIN arms b ON a.junction_id = b.junction_id WHERE a.roads_in > 0 AND b.roads_out > 0 AND a.sector <> b.sector),
    q AS (SELECT *, least(d, 360 - d) AS o, row_number() OVER (PARTITION BY junction_id, f ORDER BY least(d, 360 - d), t) AS rn FROM p), w AS (SELECT junction_id, f, max(CASE WHEN rn = 1 THEN t END) AS t, max(CASE WHEN rn = 1 THEN o END) AS o, max(CASE WHEN rn = 2 THEN o END) AS o2 FROM q GROUP BY ALL)
    SELECT junction_id, f AS from_sector, CASE WHEN o2 IS NULL OR o2 - o >= 5 THEN t END AS straight_sector, CAST(o AS DOUBLE) AS off_deg, CASE WHEN o2 IS NULL OR o2 - o >= 5 THEN 'unique' ELSE 'ambiguous' END AS state FROM w""")
def _(v):
    return AR.movement_evidence(arms(v))


@query("receiving_roles", """SELECT to_road, count(*) AS feeders, CASE WHEN bool_or(movement_type = 'straight') THEN 'main_receiving' WHEN bool_or(movement_type = 'left') AND bool_or(movement_type = 'right') THEN 'mixed_turn_receiving' WHEN bool_or(movement_type = 'left') THEN 'left_receiving'
    WHEN bool_or(movement_type = 'right') THEN 'right_receiving' ELSE 'unknown' END AS role FROM movements GROUP BY to_road""")
def _(v):
    return AR.receiving_roles(movements(v))


@query("rnr_scan", "SELECT from_road, to_road FROM movements WHERE from_road IN (SELECT s_suppkey * 7 FROM supplier)")
def _(v):
    text = movements(v).select(F.to_json(F.struct("from_road", "to_road")).alias("value"))
    rows = text.select(F.from_json("value", "from_road bigint, to_road bigint").alias("r")).select("r.*")
    needed = v.supplier.select((F.col("s_suppkey") * 7).alias("from_road"))
    return rows.join(needed, "from_road", "left_semi").select("from_road", "to_road")
