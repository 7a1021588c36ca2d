"""Orders, running values and first rows per group."""
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalar import rounded
from ..lineage import cut
from ..operators import joins as J
from ..operators import ordered as O
from ..operators.angles import bundle_arms, straightest
from ..operators.arms import incident_ends
from ..operators.topk import first_per_key, full_rank, margin_to_second, top_k
from .joins import canon_roads
from .registry import query
from .views import VIEW_SQL

VIEW_SQL["owner_scores"] = """SELECT DISTINCT l_partkey AS road_id, l_suppkey AS segment_id, (l_partkey * 7 + l_suppkey * 13) % 5 AS tight,
    (l_partkey + l_suppkey) % 7 AS broad, (l_partkey * 3 + l_suppkey) % 11 AS dist FROM lineitem"""
VIEW_SQL["track_gaps"] = """SELECT traj, seq, ts_us, x, ts_us - lag(ts_us) OVER w AS dt, abs(x - lag(x) OVER w) AS dx FROM track_points
    WINDOW w AS (PARTITION BY traj ORDER BY ts_us, seq)"""
VIEW_SQL["track_parts"] = """SELECT *, CAST(sum(CASE WHEN dt > 21600000000 OR dx > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY traj ORDER BY ts_us, seq) AS BIGINT) + 1 AS part_no
    FROM track_gaps"""


def owner_scores(v):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return v.lineitem.select(p.alias("road_id"), s.alias("segment_id"), ((p * 7 + s * 13) % 5).alias("tight"),
                             ((p + s) % 7).alias("broad"), ((p * 3 + s) % 11).alias("dist")).distinct()


@query("rank_owner_candidates", """WITH r AS (SELECT *, row_number() OVER w AS rn, rank() OVER (PARTITION BY road_id ORDER BY tight DESC, broad DESC, dist) AS rk FROM owner_scores
    WINDOW w AS (PARTITION BY road_id ORDER BY tight DESC, broad DESC, dist, segment_id)) SELECT road_id,
    max(CASE WHEN rn = 1 THEN segment_id END) AS owner_id, count(*) FILTER (WHERE rk = 1) > 1 AS ambiguous FROM r GROUP BY road_id""")
def _(v):
    from ..plans.quality import road_owners
    return road_owners(owner_scores(v)).select("road_id", "owner_id", "ambiguous")


@query("margin_to_second", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY dist, segment_id) AS rn FROM owner_scores)
    SELECT road_id, max(CASE WHEN rn = 1 THEN segment_id END) AS best_id, max(CASE WHEN rn = 1 THEN dist END) AS best_score,
    max(CASE WHEN rn = 2 THEN dist END) - max(CASE WHEN rn = 1 THEN dist END) AS margin FROM r GROUP BY road_id""")
def _(v):
    return margin_to_second(owner_scores(v), ["road_id"], "dist", "segment_id")


@query("gap_sessionize", "SELECT traj, seq, part_no FROM track_parts")
def _(v):
    gap = (F.col("ts_us") - F.col("prev_ts_us") > 21_600_000_000) | (F.abs(F.col("x") - F.col("prev_x")) > 300)
    parts = O.sessionize(v.track_points, "traj", ["ts_us", "seq"], gap, ["ts_us", "x"], 86_400_000_000.0)
    return parts.select("traj", "seq", (F.col("part_no") + 1).alias("part_no"))


@query("sequence_gap_check", """SELECT conv_id, count(*) AS n, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS complete FROM conversations GROUP BY 1""")
def _(v):
    return v.conversations.groupBy("conv_id").agg(
        F.count("*").alias("n"), ((F.min("turn") == 0) & (F.max("turn") == F.count("*") - 1) & (
            F.count_distinct("turn") == F.count("*"))).alias("complete"))


@query("cumulative_measure", """SELECT id, pos + 1 AS pos, round(start + len, 4) AS measure_m FROM road_pieces UNION ALL SELECT id, 0, 0 FROM net_roads""")
def _(v):
    vertices = v.net_roads.select("id", F.posexplode(G.measured_pieces(F.col("pts"))).alias("pos", "q"))
    measured = vertices.select("id", (F.col("pos") + 1).alias("pos"), rounded(F.col("q.start") + F.col("q.len"), 4).alias("measure_m"))
    return measured.unionAll(v.net_roads.select("id", F.lit(0), F.lit(0.0)))


@query("topk_candidates", """SELECT road_id, segment_id, dist, CAST(rn AS INTEGER) AS rank_no FROM (SELECT *, row_number() OVER (PARTITION BY road_id ORDER BY dist, segment_id) AS rn FROM owner_scores) WHERE rn <= 3""")
def _(v):
    return top_k(owner_scores(v), ["road_id"], [F.col("dist"), F.col("segment_id")], 3).select("road_id", "segment_id", "dist", "rank_no")


@query("primary_by_priority", """SELECT o_custkey, o_orderkey AS primary_id, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def _(v):
    firsts = first_per_key(v.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderkey")])
    return firsts.select("o_custkey", F.col("o_orderkey").alias("primary_id"), "o_orderpriority")


def turn_sides(v):
    """Headings into and angles out of every junction, in whole degrees."""
    angle = (F.round(F.col("angle") * 1000) % 360000).cast("bigint")
    # only the first and last point of a road count; its ends are read by both sides
    roads = v.net_roads.select("id", "snodeid", "enodeid", "direction", F.array(F.get("pts", F.lit(0)), F.element_at("pts", -1)).alias("pts"))
    ends = incident_ends(J.with_canonical_ends(roads, J.canonical_nodes(v.net_nodes))).where(F.col("angle").isNotNull())
    ends = cut(ends.select("junction_id", "id", "role", angle.alias("angle")))
    incoming = ends.where(F.col("role").isin("inbound", "bidirectional")).select(
        "junction_id", F.col("id").alias("in_id"), (((F.col("angle") + 180000) % 360000) / 1000).alias("heading"))
    outgoing = ends.where(F.col("role").isin("outbound", "bidirectional")).select(
        "junction_id", F.col("id").alias("out_id"), (F.col("angle") / 1000).alias("angle"))
    return incoming, outgoing


@query("min_angle_successor", """WITH e AS (SELECT junction_id, id, role, CAST(round(angle * 1000) AS BIGINT) % 360000 AS a FROM arm_ends WHERE angle IS NOT NULL),
    p AS (SELECT i.junction_id, i.id AS in_id, o.id AS out_id, abs((i.a + 180000) % 360000 - o.a) AS d FROM e i JOIN e o ON i.junction_id = o.junction_id
    WHERE i.role <> 'outbound' AND o.role <> 'inbound'),
    q AS (SELECT *, least(d, 360000 - d) AS t, row_number() OVER (PARTITION BY junction_id, in_id ORDER BY least(d, 360000 - d), out_id) AS rn FROM p)
    SELECT junction_id, in_id, round(t / 1000.0, 3) AS turn_deg FROM q WHERE rn = 1""")
def _(v):
    incoming, outgoing = turn_sides(v)
    return straightest(incoming, outgoing, ["junction_id"]).select("junction_id", "in_id", F.round("turn_deg", 3).alias("turn_deg"))


@query("review_ordering", """SELECT doc_id, bucket, n_chars, rank_no FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS bucket, n_chars,
    CAST(row_number() OVER (PARTITION BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank_no FROM scored)""")
def _(v):
    bucket = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    rows = v.scored.select("doc_id", bucket.alias("bucket"), "n_chars")
    return full_rank(rows, "bucket", "n_chars", "doc_id")


@query("true_runs", """WITH f AS (SELECT user_id, ts, event_id, value > 50 AS flag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) -
    row_number() OVER (PARTITION BY user_id, value > 50 ORDER BY ts, event_id) AS g FROM events)
    SELECT user_id, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM f WHERE flag GROUP BY user_id, g""")
def _(v):
    rows = v.events.select("user_id", F.unix_micros("ts").alias("t"), "event_id", (F.col("value") > 50).alias("flag"))
    runs = O.sessionize(rows, "user_id", ["t", "event_id"], F.col("flag") != F.coalesce("prev_flag", F.lit(False)), ["flag"], 86_400_000_000.0)
    return runs.where("flag").groupBy("user_id", "part_no").agg(
        F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.count("*").alias("n")).drop("part_no")


@query("arm_bundle")
def _(v):
    return bundle_arms(incident_ends(canon_roads(v)))
