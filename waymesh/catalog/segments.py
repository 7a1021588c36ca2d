"""Segment building."""
from pyspark.sql import functions as F

from ..operators import graph as GR
from ..plans import segment as SG
from .chains import chain_lines
from .geometry import chord
from .graphs import chain_edges
from .joins import canon_roads
from .registry import query
from .views import VIEW_SQL
from .windows import turn_sides

VIEW_SQL["families"] = """SELECT node, family, count(*) AS roads, CAST(count_if(in_segment) AS BIGINT) AS segment_roads, bool_or(i) AS has_in, bool_or(o) AS has_out FROM (
    SELECT src AS node, dst AS family, road_id % 4 = 0 AS in_segment, direction <> 2 AS i, direction <> 3 AS o FROM chain_edges WHERE formway & 128 = 0 UNION ALL
    SELECT dst, src, road_id % 4 = 0, direction <> 3, direction <> 2 FROM chain_edges WHERE formway & 128 = 0) GROUP BY node, family"""


def typed_nodes(v):
    """Grades and kinds of the chain nodes: half of them plain crosses of grade one."""
    i = F.col("id")
    return v.net_nodes.select(i.alias("node"), F.when(i % 4 < 3, 1).otherwise(2).alias("grade_2"), F.when(i % 4 < 3, 4).otherwise(2048).alias("kind_2"), "closed_con")


_TYPED = "typed AS (SELECT id AS node, CASE WHEN id % 4 < 3 THEN 1 ELSE 2 END AS grade_2, CASE WHEN id % 4 < 3 THEN 4 ELSE 2048 END AS kind_2 FROM net_nodes)"


def families(v):
    return SG.neighbour_families(chain_edges(v).withColumn("in_segment", F.col("road_id") % 4 == 0))


def seeds_and_through(v, remainders):
    hit = (F.col("id") % 8).isin(*remainders)
    return (v.net_nodes.where(hit).select(F.col("id").alias("node")), v.net_nodes.where(~hit).select(F.col("id").alias("node")))


@query("working_filter", """SELECT road_id FROM chain_edges e JOIN net_nodes a ON a.id = src JOIN net_nodes b ON b.id = dst WHERE a.closed_con IN (2, 3) AND b.closed_con IN (2, 3)
    AND roadtype <> 1 AND formway <> 128""")
def _(v):
    roads = chain_edges(v).withColumnRenamed("roadtype", "road_kind")
    return SG.working_layers(v.net_nodes.select(F.col("id").alias("node"), "closed_con"), roads).select("road_id")


@query("bootstrap_strict_t", f"""WITH {_TYPED}, c AS (SELECT f.node, count(*) AS families, sum(segment_roads) AS sr, count_if(has_in AND has_out) AS th, count_if(has_in AND has_out AND t.grade_2 = 1 AND t.kind_2 = 4) AS tp,
    count_if(NOT (has_in AND has_out) AND roads = 1 AND has_in <> has_out AND t.grade_2 = 1 AND t.kind_2 = 4) AS ps, count_if(NOT (has_in AND has_out) AND roads = 1 AND has_in <> has_out AND t.kind_2 = 2048 AND t.grade_2 >= 2) AS ts
    FROM families f LEFT JOIN typed t ON t.node = f.family GROUP BY f.node), h AS (SELECT *, families = 3 AND sr = 0 AND th = 1 AND tp = 1 AND ps = 1 AND ts = 1 AS hit FROM c)
    SELECT n.node, hit AS retyped, CASE WHEN hit THEN 2 ELSE n.grade_2 END AS new_grade_2, CASE WHEN hit THEN 2048 ELSE n.kind_2 END AS new_kind_2 FROM typed n JOIN h ON h.node = n.node WHERE n.grade_2 = 1 AND n.kind_2 = 4""")
def _(v):
    return SG.retype_strict_t(typed_nodes(v), families(v))


@query("refresh_retype", f"""WITH {_TYPED}, c AS (SELECT node, count(*) AS families, CAST(count_if(segment_roads > 0) AS BIGINT) AS segment_families, CAST(count_if(segment_roads = 0) AS BIGINT) AS residual_families,
    CAST(count_if(segment_roads = 0 AND roads = 1 AND has_in <> has_out) AS BIGINT) AS simple_families FROM families GROUP BY node), h AS (SELECT *, families = 3 AND segment_families = 1 AND residual_families = 2 AS hit FROM c)
    SELECT n.node, families, segment_families, residual_families, simple_families, CASE WHEN hit THEN CASE WHEN simple_families = 2 THEN 'single_side_family' ELSE 'mixed_side_family' END END AS rule,
    CASE WHEN hit THEN 2 ELSE grade_2 END AS new_grade_2, CASE WHEN hit AND simple_families = 2 THEN 2048 ELSE kind_2 END AS new_kind_2 FROM typed n JOIN h USING (node) WHERE grade_2 = 1 AND kind_2 = 4""")
def _(v):
    return SG.retype_refresh(typed_nodes(v), families(v))


@query("segment_pairs", """WITH r(seed, node, d, seen) AS (SELECT id, id, 0::BIGINT, [id] FROM net_nodes WHERE id % 8 IN (1, 4, 7) UNION ALL SELECT r.seed, e.dst, r.d + e.length_m, list_append(seen, e.dst) FROM r
    JOIN chain_directed e ON e.src = r.node WHERE (r.node = r.seed OR r.node % 8 NOT IN (1, 4, 7)) AND NOT list_contains(seen, e.dst)),
    h AS (SELECT seed, node, min(d) AS d FROM r WHERE seed <> node AND node % 8 IN (1, 4, 7) GROUP BY ALL)
    SELECT h.seed AS a, h.node AS b, CAST(h.d AS DOUBLE) AS forward_m, CAST(k.d AS DOUBLE) AS backward_m FROM h JOIN h k ON k.seed = h.node AND k.node = h.seed WHERE h.seed < h.node""")
def _(v):
    seeds, through = seeds_and_through(v, (1, 4, 7))
    return SG.segment_pairs(GR.directed_edges(chain_edges(v)), seeds, through)


_TURN = """CASE WHEN (xs[{a}] = xs[{b}] AND ys[{a}] = ys[{b}]) OR (xs[{b}] = xs[{c}] AND ys[{b}] = ys[{c}]) THEN NULL ELSE degrees(acos(greatest(-1, least(1, ((xs[{b}] - xs[{a}]) * (xs[{c}] - xs[{b}])
    + (ys[{b}] - ys[{a}]) * (ys[{c}] - ys[{b}])) / nullif(sqrt(pow(xs[{b}] - xs[{a}], 2) + pow(ys[{b}] - ys[{a}], 2)) * sqrt(pow(xs[{c}] - xs[{b}], 2) + pow(ys[{c}] - ys[{b}], 2)), 0))))) END"""
VIEW_SQL["road_turns"] = f"SELECT id, {_TURN.format(a=1, b=2, c=3)} AS t1, {_TURN.format(a=2, b=3, c=4)} AS t2 FROM net_roads"


@query("pair_validate", """SELECT id AS pair_id, round(d, 3) AS separation_m, round(greatest(t1, t2), 3) AS turn_deg, CASE WHEN d > greatest(20, id % 30) THEN 'dual_separation_exceeded'
    WHEN greatest(t1, t2) > 60 THEN 'internal_turn_exceeded' END AS reject_reason FROM road_turns JOIN (SELECT id, max(d) AS d FROM chord_distances GROUP BY id) USING (id)""")
def _(v):
    pairs = v.spread(v.net_roads).select(F.col("id").alias("pair_id"), "pts", chord(F.col("pts")).alias("opposite"), (F.col("id") % 30).alias("junction_width"))
    return SG.validate_pairs(pairs, 20.0).select("pair_id", F.round("separation_m", 3).alias("separation_m"), F.round("turn_deg", 3).alias("turn_deg"), "reject_reason")


@query("pair_arbitrate")
def _(v):
    members = v.lineitem.select(F.col("l_orderkey").alias("owner"), (F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("member"))
    owners = members.select("owner").distinct().withColumn("rank", F.struct((F.col("owner") * 37 % 1009).alias("s"), "owner"))
    return SG.arbitrate_pairs(members, owners).select("owner", "accepted")


@query("segment_body_prune", """SELECT road_id FROM chain_edges e WHERE unit IN (SELECT (id - 1) // 8 FROM net_nodes WHERE id % 8 = 6) AND (road_id > 10000000000 OR src % 8 BETWEEN 1 AND 5)""")
def _(v):
    ends = v.net_nodes.where((F.col("id") % 8).isin(1, 6)).select(F.floor((F.col("id") - 1) / 8).alias("unit"), F.col("id").alias("node"))
    return SG.segment_body(chain_edges(v), ends).select("road_id")


@query("staged_residual_rounds")
def _(v):
    edges = GR.both_ways(chain_edges(v).select("src", "dst", "road_id", "length_m"))
    stages = [(name, *seeds_and_through(v, remainders)) for name, remainders in (("4", (1, 6)), ("5A", (2, 5, 7)), ("5B", (0, 3)))]
    # what is left goes to an adaptive last stage between all fit nodes; only roundabouts stop it for certain
    fit = v.net_nodes.where(F.col("closed_con").isin(2, 3) & F.col("kind_2").isin(4, 64, 2048) & F.col("grade_2").isin(1, 2, 3))
    last = (fit.select(F.col("id").alias("node")), v.net_nodes.select(F.col("id").alias("node")), fit.where("kind_2 = 64").select(F.col("id").alias("node")))
    return SG.staged_rounds(edges, [*stages, ("5C", *last)])


@query("oneway_completion")
def _(v):
    incoming, outgoing = turn_sides(v)
    stops = v.net_nodes.where(F.col("kind_2").isin(4, 64)).select(F.col("id").alias("junction_id"))
    traces = SG.oneway_trace(canon_roads(v), incoming, outgoing, stops)
    return SG.oneway_completion(traces, v.net_roads.select(F.col("id").alias("road_id"), "direction"))


@query("shape_control", """SELECT id, 0 AS pos, 0 AS shape_no FROM road_turns UNION ALL SELECT id, 1, CASE WHEN t1 > 60 THEN 1 ELSE 0 END FROM road_turns
    UNION ALL SELECT id, 2, CASE WHEN t1 > 60 THEN 1 ELSE 0 END + CASE WHEN t2 > 60 THEN 1 ELSE 0 END FROM road_turns""")
def _(v):
    return SG.shape_cuts(v.net_roads.select("id", "pts"))


@query("unsegmented_roads", "SELECT id FROM net_roads WHERE id NOT IN (SELECT segment_id FROM seg_nodes WHERE pos = 3)")
def _(v):
    taken = v.seg_nodes.where("pos = 3").select(F.col("segment_id").alias("id"))
    return v.net_roads.select("id").join(taken, "id", "left_anti")
