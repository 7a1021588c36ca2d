"""Polyline functions over road lines; the SQL side works on exploded pieces and samples."""
import math

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.scalar import rounded
from .registry import query
from .views import VIEW_SQL

VIEW_SQL["road_pieces"] = """SELECT id, pos, x0, y0, x1, y1, len, coalesce(sum(len) OVER (PARTITION BY id ORDER BY pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM (SELECT id, CAST(i - 1 AS INTEGER) AS pos, xs[i] AS x0,
    ys[i] AS y0, xs[i + 1] AS x1, ys[i + 1] AS y1,
    sqrt((xs[i + 1] - xs[i]) * (xs[i + 1] - xs[i]) + (ys[i + 1] - ys[i]) * (ys[i + 1] - ys[i])) AS len
    FROM net_roads, (SELECT unnest([1, 2, 3]) AS i))"""
VIEW_SQL["road_length"] = "SELECT id, sum(len) AS total FROM road_pieces GROUP BY id"
VIEW_SQL["road_samples"] = """SELECT id, i, n, CASE WHEN len > 0 THEN x0 + (x1 - x0) * least(1, greatest(0, (m_at - start) / len)) ELSE x0 END AS x,
    CASE WHEN len > 0 THEN y0 + (y1 - y0) * least(1, greatest(0, (m_at - start) / len)) ELSE y0 END AS y FROM (
    SELECT t.id, i, n, m_at, x0, y0, x1, y1, len, start, row_number() OVER (PARTITION BY t.id, i ORDER BY
    CASE WHEN start + len >= m_at THEN 0 ELSE 1 END, CASE WHEN start + len >= m_at THEN pos ELSE -pos END) AS rn
    FROM (SELECT id, i, n, total * i / n AS m_at FROM (SELECT id, total, n, unnest(range(0, n + 1)) AS i FROM (
    SELECT id, total, greatest(1, CAST(ceil(total / 10) AS INTEGER)) AS n FROM road_length))) t JOIN road_pieces p ON p.id = t.id) WHERE rn = 1"""
_SEG_DIST = """sqrt(pow(px - x0 - greatest(0, least(1, CASE WHEN l2 > 0 THEN ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / l2 ELSE 0 END)) * (x1 - x0), 2)
    + pow(py - y0 - greatest(0, least(1, CASE WHEN l2 > 0 THEN ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / l2 ELSE 0 END)) * (y1 - y0), 2))"""
VIEW_SQL["chord_distances"] = f"""SELECT id, i, {_SEG_DIST} AS d FROM (SELECT s.id, s.i, s.x AS px, s.y AS py, xs[1] AS x0, ys[1] AS y0,
    xs[4] AS x1, ys[4] AS y1, pow(xs[4] - xs[1], 2) + pow(ys[4] - ys[1], 2) AS l2 FROM road_samples s JOIN net_roads r ON r.id = s.id)"""
VIEW_SQL["chord_back_distances"] = f"""SELECT id, i, min({_SEG_DIST}) AS d FROM (SELECT p.id, i, x0, y0, x1, y1, len * len AS l2,
    ax + (bx - ax) * i / n AS px, ay + (by_ - ay) * i / n AS py FROM road_pieces p JOIN (SELECT id, ax, bx, ay, by_, n,
    unnest(range(0, n + 1)) AS i FROM (SELECT id, xs[1] AS ax, xs[4] AS bx, ys[1] AS ay, ys[4] AS by_,
    greatest(1, CAST(ceil(sqrt(pow(xs[4] - xs[1], 2) + pow(ys[4] - ys[1], 2)) / 10) AS INTEGER)) AS n FROM net_roads)) c ON c.id = p.id) GROUP BY id, i"""


def P():
    return F.col("pts")


def chord(pts):
    return F.array(pts[0], F.element_at(pts, -1))


@query("line_length", "SELECT id, round(total, 6) AS length_m FROM road_length")
def _(v):
    return v.net_roads.select("id", rounded(G.length(P())).alias("length_m"))


@query("line_bounds", """SELECT id, list_min(xs) AS minx, list_min(ys) AS miny, list_max(xs) AS maxx, list_max(ys) AS maxy FROM net_roads""")
def _(v):
    return v.net_roads.select("id", G.bounds(P()).alias("b")).select("id", "b.*")


@query("bounds_agg", """SELECT direction, min(list_min(xs)) AS minx, min(list_min(ys)) AS miny, max(list_max(xs)) AS maxx,
    max(list_max(ys)) AS maxy FROM net_roads GROUP BY direction""")
def _(v):
    b = v.net_roads.select("direction", G.bounds(P()).alias("b"))
    return b.groupBy("direction").agg(F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"),
                                      F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))


@query("longest_part", """SELECT id, arg_max(pos, struct_pack(l := len, p := -pos)) AS part, round(max(len), 6) AS length_m
    FROM road_pieces GROUP BY id""")
def _(v):
    parts = F.transform(F.sequence(F.lit(0), F.size(P()) - 2), lambda i: F.slice(P(), i + 1, F.lit(2)))
    best = F.array_max(F.transform(parts, lambda p, i: F.struct(G.length(p).alias("len"), (-i).alias("neg"))))
    return v.net_roads.select("id", best.alias("b")).select(
        "id", (-F.col("b.neg")).alias("part"), rounded(F.col("b.len")).alias("length_m"))


_BEAR = "CASE WHEN {0} < 0 THEN {0} + 360 ELSE {0} END"


@query("endpoint_bearing", f"""SELECT id, round({_BEAR.format('a')}, 4) AS out_start, round({_BEAR.format('b')}, 4) AS out_end FROM (
    SELECT id, degrees(atan2(ys[2] - ys[1], xs[2] - xs[1])) AS a, degrees(atan2(ys[3] - ys[4], xs[3] - xs[4])) AS b FROM net_roads)""")
def _(v):
    return v.net_roads.select("id", rounded(G.outward_angle(P(), F.lit(True)), 4).alias("out_start"),
                              rounded(G.outward_angle(P(), F.lit(False)), 4).alias("out_end"))


@query("turn_angle", """SELECT id, round(degrees(acos(greatest(-1, least(1, ((xs[2] - xs[1]) * (xs[4] - xs[3]) + (ys[2] - ys[1]) * (ys[4] - ys[3]))
    / nullif(sqrt(pow(xs[2] - xs[1], 2) + pow(ys[2] - ys[1], 2)) * sqrt(pow(xs[4] - xs[3], 2) + pow(ys[4] - ys[3], 2)), 0))))), 4) AS turn_deg
    FROM net_roads""".replace("round(degrees(acos(greatest(-1, least(1, ", "CASE WHEN (xs[2] = xs[1] AND ys[2] = ys[1]) OR (xs[4] = xs[3] AND ys[4] = ys[3]) THEN NULL ELSE round(degrees(acos(greatest(-1, least(1, ").replace("))))), 4) AS", "))))), 4) END AS"))
def _(v):
    q = G.pieces(P())
    first, last = q[0], F.element_at(q, -1)
    return v.net_roads.select("id", F.round(G.turn_angle(
        first["x1"] - first["x0"], first["y1"] - first["y0"], last["x1"] - last["x0"], last["y1"] - last["y0"]), 4).alias("turn_deg"))


@query("angular_distance", """SELECT id, least((id * 37) % 360, 360 - (id * 37) % 360) AS diff_deg FROM net_roads""")
def _(v):
    a = F.col("id") * 41 % 360
    b = F.col("id") * 4 % 360
    return v.net_roads.select("id", G.angular_distance(a, b).alias("diff_deg"))


@query("circular_mean", """SELECT snodeid, round(CASE WHEN m < 0 THEN m + 360 ELSE m END, 3) AS mean_deg FROM (SELECT snodeid,
    degrees(atan2(avg(sin(radians(id % 90))), avg(cos(radians(id % 90))))) AS m FROM net_roads GROUP BY snodeid)""")
def _(v):
    return v.net_roads.groupBy("snodeid").agg(F.round(G.circular_mean((F.col("id") % 90).cast("double")), 3).alias("mean_deg"))


@query("interpolate_on_line", """SELECT s.id, round(x, 4) AS x, round(y, 4) AS y FROM (
    SELECT t.id, arg_min(x0 + (x1 - x0) * CASE WHEN len > 0 THEN (m_at - start) / len ELSE 0 END, pos) AS x,
    arg_min(y0 + (y1 - y0) * CASE WHEN len > 0 THEN (m_at - start) / len ELSE 0 END, pos) AS y
    FROM (SELECT id, total * 0.37 AS m_at FROM road_length) t JOIN road_pieces p ON p.id = t.id AND start + len >= m_at GROUP BY t.id) s""")
def _(v):
    at = G.interpolate(G.measured_pieces(P()), G.length(P()) * 0.37)
    return v.net_roads.select("id", at.alias("p")).select("id", rounded(F.col("p.x"), 4).alias("x"), rounded(F.col("p.y"), 4).alias("y"))


@query("sample_line", "SELECT id, CAST(i AS INTEGER) AS i, round(x, 4) + 0 AS x, round(y, 4) + 0 AS y FROM road_samples")
def _(v):
    samples = v.spread(v.net_roads).select("id", F.posexplode(G.sample(P(), 10.0)).alias("i", "p"))
    return samples.select("id", "i", rounded(F.col("p.x"), 4).alias("x"), rounded(F.col("p.y"), 4).alias("y"))


def _nearest_by_pow(places):
    return None if places is None else min((math.sqrt(math.pow(q.ex, 2) + math.pow(q.ey, 2)), q.measure) for q in places)


@query("project_point_on_line", f"""SELECT id, round(d, 4) AS dist_m, round(measure, 4) AS measure_m FROM (SELECT id, d, measure,
    row_number() OVER (PARTITION BY id ORDER BY d, measure) AS rn FROM (SELECT id, {_SEG_DIST} AS d, start + len *
    greatest(0, least(1, CASE WHEN l2 > 0 THEN ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / l2 ELSE 0 END)) AS measure
    FROM (SELECT p.*, len * len AS l2, xs[1] + r.id % 31 - 15 AS px, ys[1] + r.id % 27 - 13 AS py FROM road_pieces p JOIN net_roads r ON r.id = p.id)))
    WHERE rn = 1""")
def _(v):
    p = G.point(P()[0]["x"] + F.col("id") % 31 - 15, P()[0]["y"] + F.col("id") % 27 - 13)
    placed = v.net_roads.select("id", G.projections(p, P()).alias("c")).select("id", "c", F.array_min("c").alias("n"))
    n = F.col("n")
    rivals = F.filter("c", lambda q: (q["dist"] <= n["dist"] * (1 + 1e-12)) & (F.abs(q["measure"] - n["measure"]) > 1e-6))
    # the SQL engine squares by the C library's pow, whose last digit decides between places that are equally near
    settled = placed.select("id", "n", F.when(F.size(rivals) > 0, F.col("c")).alias("tied")).select(
        "id", "n", F.when(F.col("tied").isNotNull(), F.udf(_nearest_by_pow, "struct<dist:double,measure:double>")("tied")).alias("t"))
    return settled.select("id", F.round(F.coalesce("t.dist", "n.dist"), 4).alias("dist_m"), F.round(F.coalesce("t.measure", "n.measure"), 4).alias("measure_m"))


@query("max_sampled_distance", "SELECT id, round(max(d), 4) AS max_m FROM chord_distances GROUP BY id")
def _(v):
    return v.spread(v.net_roads).select("id", F.round(G.max_sampled_distance(P(), chord(P()), 10.0), 4).alias("max_m"))


@query("chamfer_distance", """SELECT a.id, round((a.d + b.d) / 2, 4) AS chamfer_m FROM
    (SELECT id, avg(d) AS d FROM chord_distances GROUP BY id) a JOIN (SELECT id, avg(d) AS d FROM chord_back_distances GROUP BY id) b ON a.id = b.id""")
def _(v):
    return v.spread(v.net_roads).select("id", F.round(G.chamfer_distance(P(), chord(P()), 10.0), 4).alias("chamfer_m"))


@query("coverage_ratio", "SELECT id, round(count_if(d <= 5) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM chord_distances GROUP BY id")
def _(v):
    return v.spread(v.net_roads).select("id", F.round(G.coverage_ratio(P(), chord(P()), 5.0, 10.0), 6).alias("ratio"))


@query("substring_line", """SELECT l.id, round(total * 0.5, 4) AS length_m, count(p.pos) + 2 AS points FROM road_length l LEFT JOIN road_pieces p
    ON p.id = l.id AND start > total * 0.25 AND start < total * 0.75 GROUP BY l.id, total""")
def _(v):
    total = G.length(P())
    part = G.substring(P(), total * 0.25, total * 0.75)
    return v.net_roads.select("id", part.alias("part")).select(
        "id", F.round(G.length(F.col("part")), 4).alias("length_m"), F.size("part").cast("bigint").alias("points"))


@query("split_line_at_measures")
def _(v):
    cuts = G.normalized_cuts(F.array(G.length(P()) * 0.3, G.length(P()) * 0.32, G.length(P()) * 0.7), G.length(P()), 3.0, 1.0)
    parts = v.spread(v.net_roads).select("id", F.posexplode(G.split_at(P(), cuts)).alias("part", "line"))
    return parts.select("id", "part", F.round(G.length(F.col("line")), 4).alias("length_m"), F.size("line").alias("points"))


@query("trim_line_ends", """SELECT id, round(greatest(0, total - 10), 4) AS length_m FROM road_length WHERE total > 10""")
def _(v):
    long_enough = v.net_roads.where(G.length(P()) > 10)
    return long_enough.select("id", F.round(G.length(G.substring(P(), F.lit(5.0), G.length(P()) - 5)), 4).alias("length_m"))


@query("connect_lines_by_nearest_ends", """WITH p AS (SELECT a.id, unnest([struct_pack(d := sqrt(pow(a.x1 - b.x0, 2) + pow(a.y1 - b.y0, 2)), s := 0, t := 1),
    struct_pack(d := sqrt(pow(a.x1 - b.x1, 2) + pow(a.y1 - b.y1, 2)), s := 0, t := 0),
    struct_pack(d := sqrt(pow(a.x0 - b.x0, 2) + pow(a.y0 - b.y0, 2)), s := 1, t := 1),
    struct_pack(d := sqrt(pow(a.x0 - b.x1, 2) + pow(a.y0 - b.y1, 2)), s := 1, t := 0)]) AS o,
    a.x0 AS ax0, a.x1 AS ax1, b.x0 AS bx0, b.x1 AS bx1 FROM link_roads a JOIN link_roads b ON b.id = a.id + 1)
    SELECT id, CASE WHEN min(o).s = 1 THEN any_value(ax1) ELSE any_value(ax0) END AS first_x,
    CASE WHEN min(o).t = 1 THEN any_value(bx1) ELSE any_value(bx0) END AS last_x,
    CASE WHEN min(o).d <= 0.00000001 THEN 3 ELSE 4 END AS points FROM p GROUP BY id""")
def _(v):
    a, b = v.link_roads.select("id", "pts"), v.link_roads.select((F.col("id") - 1).alias("id"), F.col("pts").alias("next"))
    line = a.join(b, "id").select("id", G.connect(P(), F.col("next")).alias("line"))
    return line.select("id", F.col("line")[0]["x"].alias("first_x"), F.element_at("line", -1)["x"].alias("last_x"),
                       F.size("line").alias("points"))


@query("orient_line_to_direction", "SELECT id, CASE WHEN direction = 3 THEN xs[4] ELSE xs[1] END AS first_x FROM net_roads")
def _(v):
    return v.net_roads.select("id", G.orient(P(), F.col("direction") == 3)[0]["x"].alias("first_x"))


@query("tangent_and_side", """SELECT id, CASE WHEN side > 0 THEN 'left' WHEN side < 0 THEN 'right' ELSE 'on' END AS side FROM (SELECT id,
    (x1 - x0) * ((id % 13 - 6)) - (y1 - y0) * ((id % 11 - 5)) AS side FROM link_roads)""")
def _(v):
    q = G.pieces(P())[0]
    cross = (q["x1"] - q["x0"]) * (F.col("id") % 13 - 6) - (q["y1"] - q["y0"]) * (F.col("id") % 11 - 5)
    return v.link_roads.select("id", F.when(cross > 0, "left").when(cross < 0, "right").otherwise("on").alias("side"))


@query("point_in_polygon", """SELECT surface_id, (x0 + x1) / 2 + o BETWEEN x0 AND x1 AS covers FROM surfaces, (SELECT unnest([0, 15, 34, 60]) AS o)"""
       .replace("surface_id,", "surface_id, CAST(o AS INTEGER) AS o,"))
def _(v):
    probe = v.surfaces.withColumn("o", F.explode(F.array(*[F.lit(o) for o in (0, 15, 34, 60)])))
    p = G.point((F.col("x0") + F.col("x1")) / 2 + F.col("o"), (F.col("y0") + F.col("y1")) / 2)
    return probe.select("surface_id", "o", G.ring_covers(p, F.col("ring")).alias("covers"))


@query("sampled_buffer_mismatch", """SELECT a.id, round(a.total * share, 4) AS outside_m, round(share, 6) AS outside_ratio,
    share <= 0.1 OR a.total * share <= 20 AS acceptable FROM road_length a JOIN (SELECT id, greatest(a, b) AS share FROM
    (SELECT id, count_if(d > 5) / CAST(count(*) AS DOUBLE) AS a FROM chord_distances GROUP BY id) JOIN
    (SELECT id, count_if(d > 5) / CAST(count(*) AS DOUBLE) AS b FROM chord_back_distances GROUP BY id) USING (id)) s ON s.id = a.id""")
def _(v):
    share = F.greatest(1 - G.coverage_ratio(P(), chord(P()), 5.0, 10.0), 1 - G.coverage_ratio(chord(P()), P(), 5.0, 10.0))
    measured = v.spread(v.net_roads).select("id", G.length(P()).alias("total"), share.alias("share"))
    outside = F.col("total") * F.col("share")
    return measured.select("id", F.round(outside, 4).alias("outside_m"), F.round("share", 6).alias("outside_ratio"),
                           ((F.round("share", 9) <= 0.1) | (outside <= 20)).alias("acceptable"))


@query("smooth_line", """SELECT id, pos, round((1 * coalesce(a, x) + 2 * coalesce(b, x) + 3 * x + 2 * coalesce(c, x) + 1 * coalesce(d, x)) / 9, 6) AS x FROM (
    SELECT id, CAST(i - 1 AS INTEGER) AS pos, xs[i] AS x, coalesce(xs[greatest(i - 2, 1)], xs[1]) AS a, xs[greatest(i - 1, 1)] AS b,
    xs[least(i + 1, 4)] AS c, xs[least(i + 2, 4)] AS d FROM net_roads, (SELECT unnest([1, 2, 3, 4]) AS i))""")
def _(v):
    from ..operators.smoothing import smooth_offsets
    smooth = smooth_offsets(F.transform(P(), lambda p: p["x"]))
    return v.net_roads.select("id", F.posexplode(smooth).alias("pos", "x")).select("id", "pos", rounded(F.col("x")).alias("x"))


@query("grid_cells_of_line")
def _(v):
    return v.spread(v.net_roads).select("id", F.explode(G.cells_of_line(P(), 25.0)).alias("c")).select("id", "c.cx", "c.cy")


@query("grid_cells_of_ring", """SELECT surface_id, cx, cy FROM (SELECT surface_id, x0, x1, y0, y1, cx, unnest(range(CAST(floor(y0 / 5) AS BIGINT),
    CAST(floor(y1 / 5) AS BIGINT) + 1)) AS cy FROM (SELECT *, unnest(range(CAST(floor(x0 / 5) AS BIGINT), CAST(floor(x1 / 5) AS BIGINT) + 1)) AS cx
    FROM surfaces)) WHERE (cx + 0.5) * 5 BETWEEN x0 AND x1 AND (cy + 0.5) * 5 BETWEEN y0 AND y1""")
def _(v):
    return v.surfaces.select("surface_id", F.explode(G.cells_of_ring(F.col("ring"), 5.0)).alias("c")).select(
        "surface_id", "c.cx", "c.cy")
