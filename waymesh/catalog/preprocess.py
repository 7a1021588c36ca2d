"""Preprocessing jobs."""
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import joins as J
from ..operators import spatial as SP
from ..plans import preprocess as P
from .chains import chain_lines
from .joins import canon_roads
from .registry import query
from .views import VIEW_SQL

_COVER = "(SELECT n.id FROM net_nodes n JOIN surfaces s ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)"


def node_kinds(v):
    return v.net_nodes.select(F.col("id").alias("node"), "kind_2", "x", "y")


def surface_hits(v, tolerance=0.0):
    points = v.net_nodes.select(F.col("id").alias("p_id"), "x", "y")
    return SP.points_in_rings(points, v.surfaces.select(F.col("surface_id").alias("ring_id"), "ring"), 40.0, tolerance)


@query("init_node_types", "SELECT id, kind_2 AS kind, kind_2, grade_2 AS grade, grade_2 FROM net_nodes")
def _(v):
    source = v.net_nodes.select("id", F.col("kind_2").alias("kind"), F.col("grade_2").alias("grade"))
    return source.withColumns({"kind_2": F.col("kind"), "grade_2": F.col("grade")})


@query("event_road_split", "SELECT id, CASE WHEN kind LIKE '%17|%' OR kind LIKE '%17' THEN 'event' ELSE 'road' END AS output FROM net_roads")
def _(v):
    is_event = S.kind_has_suffix(F.col("kind"), "17")
    events = v.net_roads.where(is_event).select("id", F.lit("event").alias("output"))
    return events.unionAll(v.net_roads.where(~is_event).select("id", F.lit("road").alias("output")))


@query("junction_type_repair", """WITH x AS (SELECT node, CAST(sum(i) AS BIGINT) AS ic, CAST(sum(o) AS BIGINT) AS oc FROM (SELECT src AS node, CASE WHEN direction <> 2 THEN 1 ELSE 0 END AS i,
    CASE WHEN direction <> 3 THEN 1 ELSE 0 END AS o FROM chain_edges WHERE formway & 128 = 0 UNION ALL SELECT dst, CASE WHEN direction <> 3 THEN 1 ELSE 0 END,
    CASE WHEN direction <> 2 THEN 1 ELSE 0 END FROM chain_edges WHERE formway & 128 = 0) GROUP BY node),
    e AS (SELECT src AS node FROM chain_edges WHERE formway & 128 <> 0 UNION SELECT dst FROM chain_edges WHERE formway & 128 <> 0),
    j AS (SELECT n.id AS node, n.kind_2, coalesce(d.in_degree, 0) AS in_degree, coalesce(d.out_degree, 0) AS out_degree, coalesce(ic, 0) = 2 AND coalesce(oc, 0) = 2 AND e.node IS NOT NULL AS excused
    FROM net_nodes n LEFT JOIN chain_degrees d ON d.node = n.id LEFT JOIN x ON x.node = n.id LEFT JOIN e ON e.node = n.id)
    SELECT node, kind_2, in_degree, out_degree, CASE WHEN kind_2 = 2048 AND NOT (in_degree = 2 AND out_degree = 2) AND NOT excused THEN CASE WHEN in_degree = 0 OR out_degree = 0 THEN 1 ELSE 4 END
    WHEN kind_2 IN (8, 16) AND in_degree = 1 AND out_degree = 1 THEN 1 ELSE kind_2 END AS new_kind_2 FROM j""")
def _(v):
    return P.repair_junction_types(node_kinds(v).select("node", "kind_2"), chain_lines(v).withColumn("kind", F.lit("0101")))


@query("qc_divmerge_pairs")
def _(v):
    return P.divmerge_pairs(node_kinds(v), chain_lines(v).withColumn("kind", F.lit("0101")), 2000.0, 180.0)


@query("qc_cross_errors")
def _(v):
    return P.cross_errors(node_kinds(v), chain_lines(v))


@query("complex_divmerge_aggregate")
def _(v):
    roads = canon_roads(v).select(F.col("id").alias("road_id"), "src", "dst", "direction", (F.col("id") % 90).cast("double").alias("length_m"))
    return P.aggregate_divmerge(P.divmerge_chain_edges(roads, node_kinds(v), 50.0, 80.0))


@query("one_to_many_merge")
def _(v):
    hits = surface_hits(v).select(F.col("ring_id").alias("surface_id"), F.col("p_id").alias("node"))
    return P.merge_one_to_many(hits, node_kinds(v), canon_roads(v))


VIEW_SQL["road_surface_hits"] = """SELECT DISTINCT id FROM (SELECT id, xs[i] AS xa, ys[i] AS ya, xs[i + 1] AS xb, ys[i + 1] AS yb FROM net_roads, (SELECT unnest([1, 2, 3]) AS i)) p
    JOIN surfaces ON greatest(xa, xb) >= x0 AND least(xa, xb) <= x1 AND greatest(ya, yb) >= y0 AND least(ya, yb) <= y1
    WHERE least((xb - xa) * (y0 - ya) - (yb - ya) * (x0 - xa), (xb - xa) * (y1 - ya) - (yb - ya) * (x0 - xa), (xb - xa) * (y0 - ya) - (yb - ya) * (x1 - xa), (xb - xa) * (y1 - ya) - (yb - ya) * (x1 - xa)) <= 0
    AND greatest((xb - xa) * (y0 - ya) - (yb - ya) * (x0 - xa), (xb - xa) * (y1 - ya) - (yb - ya) * (x0 - xa), (xb - xa) * (y0 - ya) - (yb - ya) * (x1 - xa), (xb - xa) * (y1 - ya) - (yb - ya) * (x1 - xa)) >= 0"""


@query("carrier_cleaning", f"""WITH g AS (SELECT canonical_id FROM canon GROUP BY canonical_id HAVING bool_and(node_id IN {_COVER})), k AS (SELECT node_id FROM canon WHERE canonical_id IN (SELECT * FROM g))
    SELECT id FROM net_roads WHERE snodeid IN (SELECT * FROM k) AND enodeid IN (SELECT * FROM k) AND id IN (SELECT id FROM road_surface_hits)""")
def _(v):
    covered = surface_hits(v).select(F.col("p_id").alias("node_id"))
    lines = v.net_roads.select(F.col("id").alias("line_id"), "pts")
    touching = SP.lines_meeting_rings(lines, v.surfaces.select(F.col("surface_id").alias("ring_id"), "ring"), 40.0).select(F.col("line_id").alias("id"))
    return P.clean_carrier(J.canonical_nodes(v.net_nodes), covered, v.net_roads, touching).select("id")


@query("trajectory_aggregate", """SELECT CAST(traj AS VARCHAR) || '__seg' || lpad(CAST(part_no AS VARCHAR), CAST(greatest(4, length(CAST(part_no AS VARCHAR))) AS INTEGER), '0') AS piece_id, traj, part_no AS piece_no, count(*) AS point_count,
    arg_min(seq, struct_pack(t := ts_us, s := seq)) AS start_seq, arg_max(seq, struct_pack(t := ts_us, s := seq)) AS end_seq, CASE WHEN count(*) < 2 THEN 'cannot_form_linestring' END AS discard_reason
    FROM track_parts GROUP BY traj, part_no""")
def _(v):
    gap = (F.col("ts_us") - F.col("prev_ts_us") > 21_600_000_000) | (F.abs(F.col("x") - F.col("prev_x")) > 300)
    return P.trajectory_parts(v.track_points, "traj", ["ts_us", "seq"], gap, ["ts_us", "x"], 86_400_000_000.0)


VIEW_SQL["surface_cells"] = """SELECT surface_id, cx, unnest(range(CAST(floor(y0 / 5) AS BIGINT), CAST(floor(y1 / 5) AS BIGINT) + 1)) AS cy, x0, x1, y0, y1 FROM
    (SELECT *, unnest(range(CAST(floor(x0 / 5) AS BIGINT), CAST(floor(x1 / 5) AS BIGINT) + 1)) AS cx FROM surfaces)"""


@query("patch_surface_merge", """SELECT source_no AS patch_id, count(*) AS cells, min(cx) AS min_cx, max(cy) AS max_cy FROM (SELECT DISTINCT source_no, cx, cy FROM surface_cells JOIN surfaces USING (surface_id)
    WHERE (cx + 0.5) * 5 BETWEEN surface_cells.x0 AND surface_cells.x1 AND (cy + 0.5) * 5 BETWEEN surface_cells.y0 AND surface_cells.y1) GROUP BY source_no""")
def _(v):
    cells = P.merged_surface_cells(v.surfaces.withColumnRenamed("source_no", "patch_id"), 5.0)
    return cells.groupBy("patch_id").agg(F.count("*").alias("cells"), F.min("cx").alias("min_cx"), F.max("cy").alias("max_cy"))


_LAYERS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE")


@query("patch_file_inventory", f"""SELECT n_nationkey AS patch_id, layer FROM nation, (SELECT unnest({list(_LAYERS)}) AS layer) EXCEPT SELECT c_nationkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey""")
def _(v):
    found = v.orders.select("o_custkey", F.col("o_orderpriority").alias("layer")).distinct().join(
        v.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("patch_id"), "layer")
    return P.missing_layers(found, v.nation.select(F.col("n_nationkey").alias("patch_id")), list(_LAYERS))
