"""Polyline and ring functions on ``ARRAY<STRUCT<x, y>>`` columns, all evaluated in the JVM."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6378137.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def pieces(pts: Column) -> Column:
    """Straight pieces of a line."""
    n = F.size(pts) - 1
    return F.zip_with(F.slice(pts, F.lit(1), n), F.slice(pts, F.lit(2), n), lambda a, b: F.struct(
        a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"), distance(a, b).alias("len")))


def measured_pieces(pts: Column) -> Column:
    """Straight pieces with the running measure at their start, built in one pass."""
    empty = F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double,len:double,start:double>>")
    return F.aggregate(pieces(pts), empty, lambda acc, p: F.concat(acc, F.array(F.struct(
        p["x0"].alias("x0"), p["y0"].alias("y0"), p["x1"].alias("x1"), p["y1"].alias("y1"), p["len"].alias("len"),
        F.coalesce(F.try_element_at(acc, F.lit(-1))["start"] + F.try_element_at(acc, F.lit(-1))["len"],
                   F.lit(0.0)).alias("start")))))


def length(pts: Column) -> Column:
    return F.aggregate(pieces(pts), F.lit(0.0), lambda acc, p: acc + p["len"])


def bounds(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def orient(pts: Column, flip: Column) -> Column:
    return F.when(flip, F.reverse(pts)).otherwise(pts)


def bearing(a: Column, b: Column) -> Column:
    """Mathematical angle of a → b in [0, 360)."""
    angle = F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))
    return F.when(angle < 0, angle + 360).otherwise(angle)


def outward_angle(pts: Column, at_start: Column) -> Column:
    """Angle with which a line leaves the junction at one of its ends."""
    return F.when(at_start, bearing(pts[0], pts[1])).otherwise(
        bearing(F.element_at(pts, -1), F.element_at(pts, -2)))


def angular_distance(a: Column, b: Column) -> Column:
    diff = F.abs(a - b) % 360
    return F.least(diff, 360 - diff)


def circular_mean(angle: Column) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    mean = F.degrees(F.atan2(F.avg(F.sin(F.radians(angle))), F.avg(F.cos(F.radians(angle)))))
    return F.when(mean < 0, mean + 360).otherwise(mean)


def turn_angle(dx0: Column, dy0: Column, dx1: Column, dy1: Column) -> Column:
    """Angle between two vectors in degrees; null when one has no length."""
    norm = F.sqrt(dx0 * dx0 + dy0 * dy0) * F.sqrt(dx1 * dx1 + dy1 * dy1)
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (dx0 * dx1 + dy0 * dy1) / norm))
    return F.when(norm > 0, F.degrees(F.acos(cosine)))


def interpolate(measured: Column, at: Column) -> Column:
    """Point at a measure, on pieces from ``measured_pieces``."""
    p = F.coalesce(F.get(F.filter(measured, lambda q: q["start"] + q["len"] >= at), 0), F.element_at(measured, -1))
    return F.transform(F.array(p), lambda q: _on_piece(q, at))[0]


def _on_piece(q: Column, at: Column) -> Column:
    share = F.when(q["len"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at - q["start"]) / q["len"]))).otherwise(0.0)
    return F.struct((q["x0"] + (q["x1"] - q["x0"]) * share).alias("x"),
                    (q["y0"] + (q["y1"] - q["y0"]) * share).alias("y"))


def sample(pts: Column, spacing: float) -> Column:
    """Points at even steps of at most ``spacing``, both ends included.

    Every piece yields the samples that fall on it, so a line costs one pass over its pieces.
    """
    total = length(pts)
    return F.transform(F.array(F.struct(measured_pieces(pts).alias("m"), total.alias("t"),
                                        F.greatest(F.lit(1), F.ceil(total / spacing)).cast("int").alias("n"))),
                       lambda s: F.transform(F.sequence(F.lit(0), s["n"]),
                                             lambda i: interpolate(s["m"], s["t"] * i / s["n"])))[0]


def _projection(p: Column, q: Column) -> Column:
    dx, dy = q["x1"] - q["x0"], q["y1"] - q["y0"]
    share = F.when(q["len"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        (p["x"] - q["x0"]) * dx + (p["y"] - q["y0"]) * dy) / (q["len"] * q["len"])))).otherwise(0.0)
    ex, ey = p["x"] - q["x0"] - share * dx, p["y"] - q["y0"] - share * dy
    side = dx * (p["y"] - q["y0"]) - dy * (p["x"] - q["x0"])
    return F.struct(F.sqrt(ex * ex + ey * ey).alias("dist"), (q["start"] + share * q["len"]).alias("measure"),
                    side.alias("side"), ex.alias("ex"), ey.alias("ey"))


def projections(p: Column, pts: Column) -> Column:
    """Nearest place on every piece of a line, with the offsets ``ex, ey`` from it."""
    return F.transform(measured_pieces(pts), lambda q: _projection(p, q))


def project(p: Column, pts: Column) -> Column:
    """Nearest place on a line: ``dist``, ``measure`` along it and ``side`` (positive on the left)."""
    return F.array_min(projections(p, pts))


def point_piece_distance(x: Column, y: Column, q: Column) -> Column:
    """Distance of a point to a straight piece."""
    dx, dy = q["x1"] - q["x0"], q["y1"] - q["y0"]
    share = F.when(q["len"] > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (
        (x - q["x0"]) * dx + (y - q["y0"]) * dy) / (q["len"] * q["len"])))).otherwise(0.0)
    ex, ey = x - q["x0"] - share * dx, y - q["y0"] - share * dy
    return F.sqrt(ex * ex + ey * ey)


def point_line_distance(p: Column, line_pieces: Column) -> Column:
    return F.array_min(F.transform(line_pieces, lambda q: point_piece_distance(p["x"], p["y"], q)))


def sampled_distances(pts: Column, reference: Column, spacing: float) -> Column:
    """Distance of every sample of ``pts`` to ``reference``."""
    return F.transform(F.array(F.struct(sample(pts, spacing).alias("s"), pieces(reference).alias("r"))),
                       lambda c: F.transform(c["s"], lambda p: point_line_distance(p, c["r"])))[0]


def max_sampled_distance(pts: Column, reference: Column, spacing: float) -> Column:
    return F.array_max(sampled_distances(pts, reference, spacing))


def array_mean(values: Column) -> Column:
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    return F.aggregate(values, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n")), lambda acc: acc["s"] / acc["n"])


def chamfer_distance(a: Column, b: Column, spacing: float) -> Column:
    """Mean of the two one-way mean sampled distances."""
    return (array_mean(sampled_distances(a, b, spacing)) + array_mean(sampled_distances(b, a, spacing))) / 2


def coverage_ratio(pts: Column, reference: Column, limit: float, spacing: float) -> Column:
    """Share of samples within ``limit`` of the reference."""
    start = F.struct(F.lit(0).alias("hit"), F.lit(0).alias("n"))
    return F.aggregate(sampled_distances(pts, reference, spacing), start,
                       lambda acc, d: F.struct((acc["hit"] + (d <= limit).cast("int")).alias("hit"), (acc["n"] + 1).alias("n")),
                       lambda acc: acc["hit"] / acc["n"])


def substring(pts: Column, start: Column, end: Column) -> Column:
    """Part of a line between two measures."""
    context = F.array(F.struct(measured_pieces(pts).alias("m"), start.alias("a"), end.alias("b")))
    return F.transform(context, lambda c: F.concat(
        F.array(interpolate(c["m"], c["a"])),
        F.transform(F.filter(c["m"], lambda q: (q["start"] > c["a"]) & (q["start"] < c["b"])),
                    lambda q: F.struct(q["x0"].alias("x"), q["y0"].alias("y"))),
        F.array(interpolate(c["m"], c["b"]))))[0]


def normalized_cuts(cuts: Column, total: Column, min_gap: float, end_gap: float) -> Column:
    """Sorted cut measures: those near an end are dropped, those nearer than the gap are averaged."""
    usable = F.array_sort(F.filter(cuts, lambda d: (d > end_gap) & (total - d > end_gap)))

    def step(acc: Column, d: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        merged = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array((last + d) / 2))
        return F.when(last.isNotNull() & (d - last < min_gap), merged).otherwise(F.concat(acc, F.array(d)))

    return F.aggregate(usable, F.array().cast("array<double>"), step)


def split_at(pts: Column, cuts: Column) -> Column:
    """Lines between consecutive cut measures."""
    context = F.array(F.struct(pts.alias("p"), F.concat(F.array(F.lit(0.0)), cuts, F.array(length(pts))).alias("c")))
    return F.transform(context, lambda s: F.transform(
        F.sequence(F.lit(1), F.size(s["c"]) - 1),
        lambda i: substring(s["p"], F.element_at(s["c"], i), F.element_at(s["c"], i + 1))))[0]


def connect(a: Column, b: Column, tolerance: float = 1e-8) -> Column:
    """Join two lines at their nearest ends, the first running towards the second."""
    first_a, last_a, first_b, last_b = a[0], F.element_at(a, -1), b[0], F.element_at(b, -1)

    def option(p: Column, q: Column, a_start: bool, b_start: bool) -> Column:
        return F.struct(distance(p, q).alias("d"), F.lit(a_start).alias("a_start"), F.lit(b_start).alias("b_start"))

    best = F.least(option(last_a, first_b, False, True), option(last_a, last_b, False, False),
                   option(first_a, first_b, True, True), option(first_a, last_b, True, False))
    tail = orient(b, ~best["b_start"])
    return F.concat(orient(a, best["a_start"]),
                    F.when(best["d"] <= tolerance, F.slice(tail, F.lit(2), F.size(tail) - 1)).otherwise(tail))


def on_ring_border(p: Column, ring: Column, tolerance: float = 1e-9) -> Column:
    return point_line_distance(p, pieces(ring)) <= tolerance


def ring_contains(p: Column, ring: Column) -> Column:
    """Even-odd ray test; points on the border may fall either way."""
    crossings = F.filter(pieces(ring), lambda q: ((q["y0"] > p["y"]) != (q["y1"] > p["y"])) & (
        p["x"] < (q["x1"] - q["x0"]) * (p["y"] - q["y0"]) / (q["y1"] - q["y0"]) + q["x0"]))
    return F.size(crossings) % 2 == 1


def segments_meet(p: Column, q: Column) -> Column:
    """Whether two straight pieces share a point, touching ends and overlaps included."""
    def side(s, x, y):
        return (s["x1"] - s["x0"]) * (y - s["y0"]) - (s["y1"] - s["y0"]) * (x - s["x0"])

    def apart(a, b):
        return (F.greatest(p[a], p[b]) < F.least(q[a], q[b])) | (F.least(p[a], p[b]) > F.greatest(q[a], q[b]))

    return (~apart("x0", "x1") & ~apart("y0", "y1") & (F.signum(side(q, p["x0"], p["y0"])) * F.signum(side(q, p["x1"], p["y1"])) <= 0)
            & (F.signum(side(p, q["x0"], q["y0"])) * F.signum(side(p, q["x1"], q["y1"])) <= 0))


def _end_distances(p: Column, q: Column) -> list[Column]:
    return [point_piece_distance(p["x0"], p["y0"], q), point_piece_distance(p["x1"], p["y1"], q),
            point_piece_distance(q["x0"], q["y0"], p), point_piece_distance(q["x1"], q["y1"], p)]


def piece_gap(p: Column, q: Column) -> Column:
    """Distance of two straight pieces; 0 where they meet."""
    return F.when(segments_meet(p, q), 0.0).otherwise(F.least(*_end_distances(p, q)))


def pieces_within(p, q, limit: float) -> Column:
    """Whether ``piece_gap`` is at most ``limit``; only pairs whose middles do not settle it are measured.

    ``p`` and ``q`` name columns that are never null. The exact measure stands in an array function, which keeps the code of a join small enough to be compiled.
    """
    ex, ey = (p["x0"] + p["x1"]) - (q["x0"] + q["x1"]), (p["y0"] + p["y1"]) - (q["y0"] + q["y1"])
    middles = F.sqrt(ex * ex + ey * ey) / 2
    least, most = middles <= limit * (1 - 1e-9), middles <= (limit + (p["len"] + q["len"]) / 2) * (1 + 1e-9)
    pair = F.struct(F.struct(*[c.alias(f) for f, c in p.items()]).alias("p"), F.struct(*[c.alias(f) for f, c in q.items()]).alias("q"))
    return least | (most & F.exists(F.array(pair), lambda c: piece_gap(c["p"], c["q"]) <= limit))


def piece_meets_ring(p: Column, ring: Column) -> Column:
    """Whether a straight piece lies in a ring or meets its border."""
    return F.exists(pieces(ring), lambda q: segments_meet(p, q)) | ring_contains(point(p["x0"], p["y0"]), ring)


def ring_covers(p: Column, ring: Column) -> Column:
    return ring_contains(p, ring) | on_ring_border(p, ring)


def mercator(lon: Column, lat: Column) -> Column:
    """Longitude and latitude to Web Mercator metres."""
    return point(EARTH_RADIUS_M * F.radians(lon),
                 EARTH_RADIUS_M * F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)))


def cells_of_line(pts: Column, cell: float) -> Column:
    """Distinct grid cells touched by a line sampled at half a cell."""
    return F.array_distinct(F.transform(sample(pts, cell / 2), lambda p: F.struct(
        F.floor(p["x"] / cell).alias("cx"), F.floor(p["y"] / cell).alias("cy"))))


def cells_of_box(minx: Column, miny: Column, maxx: Column, maxy: Column, cell: float) -> Column:
    xs = F.sequence(F.floor(minx / cell), F.floor(maxx / cell))
    ys = F.sequence(F.floor(miny / cell), F.floor(maxy / cell))
    return F.flatten(F.transform(xs, lambda cx: F.transform(ys, lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


def cells_of_ring(ring: Column, cell: float) -> Column:
    """Grid cells whose centre lies in a ring."""
    box = bounds(ring)
    candidates = cells_of_box(box["minx"], box["miny"], box["maxx"], box["maxy"], cell)
    return F.filter(candidates, lambda c: ring_covers(
        F.struct(((c["cx"] + 0.5) * cell).alias("x"), ((c["cy"] + 0.5) * cell).alias("y")), ring))


def vertex_turns(pts: Column) -> Column:
    """Turn in degrees at every inner vertex; null where a piece has no length."""
    q = pieces(pts)
    n = F.size(pts) - 2
    return F.zip_with(F.slice(q, F.lit(1), n), F.slice(q, F.lit(2), n), lambda a, b: turn_angle(
        a["x1"] - a["x0"], a["y1"] - a["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"]))
